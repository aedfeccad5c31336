"""Byte-level BPE with tiktoken and a local rank file; ids decode to the raw bytes.

Long texts are cut where the splitting pattern always cuts: before white space that
follows something else, and between a letter and a digit.  No match reaches over such a
place and none looks behind, so the pieces' ids joined are the ids of the whole.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import extended, flat, hash_segments, output, slices, table, unclashed
from codelake.llm.registry import query

#: The space or line feed must follow a character that no engine counts as white space.
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e\u200b])(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
PIECE_CHARS = 1 << 15


def pieces(text: str, size: int = PIECE_CHARS):
    """The text in parts of ``size`` characters and what it takes to the next safe boundary."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


_CODECS: dict[bytes, object] = {}


def codec(rank_file: bytes, pattern: str):
    """One tiktoken codec per Python process."""
    import tiktoken

    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _CODECS:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        _CODECS[key] = bpe = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        bpe.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            bpe.widths[rank] = len(token)
        bpe.decimals = [str(k) for k in range(len(bpe.widths))]
    return _CODECS[key]


def encode_text(bpe, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return bpe.encode_ordinary(text)
    ids: list[int] = []
    for part in pieces(text):
        ids += bpe.encode_ordinary(part)
    return ids


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the parts between safe blanks and line feeds.

    Before the blank stands a printable ASCII byte, or a two-byte character from U+00C0 on,
    none of which is white space; other boundaries are left out, which is safe too.
    """
    start = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before, lead = data[1:-1], data[:-2]
        solid = (before > 0x20) & (before < 0x7F) | (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
        start[2:-1] = solid & ((data[2:] == 0x20) | (data[2:] == 0x0A))
    start[offsets] = True
    start[len(data)] = False
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, side="right") - 1


def _encode_parts(bpe, widths: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all parts behind one another, number of ids of each part).

    Parts that open with a safe blank and end before one are encoded as one text; its ids
    are dealt out again by their widths in bytes.  The others go one by one.
    """
    last, lead = data[ends - 1], data[np.maximum(ends - 2, 0)]
    solid = (last > 0x20) & (last < 0x7F) | (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF) & (ends - starts > 2)
    joined = solid & ((data[starts] == 0x20) | (data[starts] == 0x0A))
    size = ends - starts
    at = np.flatnonzero(joined)
    bytes_at = np.repeat(starts[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(int(size[at].sum()))
    ids = np.array(encode_text(bpe, data[bytes_at].tobytes().decode()), np.int32)
    of = np.searchsorted(np.cumsum(size[at]), np.cumsum(widths[ids]), side="left")
    lengths = np.zeros(len(starts), np.int64)
    lengths[at] = np.bincount(of, minlength=len(at))
    rest = np.flatnonzero(~joined)
    own = [encode_text(bpe, data[a:b].tobytes().decode()) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
    lengths[rest] = [len(x) for x in own]
    out = np.zeros(int(lengths.sum()), np.int32)
    mine = np.repeat(joined, lengths)
    out[mine] = ids
    out[~mine] = np.fromiter((x for part in own for x in part), np.int32)
    return out, lengths


def encode_texts(bpe, texts: pa.Array) -> tuple[list[np.ndarray], list[str]]:
    """For each text its ids, and the ids as decimals joined by commas.

    Words repeat, so each distinct part between safe boundaries is encoded once.
    """
    data, offsets = flat(texts)
    starts, ends, doc = _segments(data, offsets)
    _, first, back = np.unique(hash_segments(data, starts, ends), return_index=True, return_inverse=True)
    own, lengths = _encode_parts(bpe, bpe.widths, data, starts[first], ends[first])
    size, from_ = lengths[back], (np.cumsum(lengths) - lengths)
    at = np.cumsum(size) - size
    ids = own[np.repeat(from_[back] - at, size) + np.arange(int(size.sum()))]
    decimal = [bpe.decimals[x] for x in own.tolist()]
    written = np.array([",".join(decimal[a : a + n]) for a, n in zip(from_.tolist(), lengths.tolist(), strict=True)] or [""], object)[back]
    cuts = np.searchsorted(doc, np.arange(len(offsets)))
    marks = np.append(at, len(ids))
    bounds = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return [ids[marks[a] : marks[b]] for a, b in bounds], [",".join(written[a:b]) for a, b in bounds]


def _mapped(df: DataFrame, rank_path: str, pattern: str, column: str, fields: str, work):
    """``work(codec, values)`` gives the new columns of a batch; the rank file (about 1 MB) is broadcast."""
    with open(rank_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    types = {k: t for k, t in (x.split(":") for x in fields.split())}
    frame = unclashed(df, list(types))
    schema = extended(frame, ", ".join(f"{k} {t}" for k, t in types.items()))
    string = frame.schema[column].dataType.typeName() == "string"
    arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def run(batches):
        bpe = codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, column, 4 << 20) if string else [batch.slice(k, 256) for k in range(0, len(batch), 256)]:
                made = work(bpe, part.column(column))
                yield output(part, part.schema.names, **{n: pa.array(made[n], arrow[t]) for n, t in types.items()})

    return frame.mapInArrow(run, schema)


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All rows with ids (array<int>) and n_tokens.

    A null text has the ids of the empty one, none.  Special tokens' names are ordinary text.
    Columns named ids or n_tokens are replaced.  ``rank_path`` is read by the driver alone.
    """
    def work(bpe, texts):
        ids, _ = encode_texts(bpe, texts)
        return {"ids": ids, "n_tokens": [len(x) for x in ids]}

    return _mapped(df, rank_path, pattern, text, "ids:array<int> n_tokens:bigint", work)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All rows with ``decoded``: the raw bytes of the ids, which need not be whole characters; null ids give none."""
    def work(bpe, rows):
        return {"decoded": [bpe.decode_bytes(r or []) for r in rows.to_pylist()]}

    return _mapped(df, rank_path, pattern, ids, "decoded:binary", work)


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All rows with n_tokens and the SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes.

    Encoding and decoding meet in one pass, so the ids need not leave the task.
    """
    def work(bpe, texts):
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids, written in zip(*encode_texts(bpe, texts), strict=True):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(written.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode_bytes(ids.tolist())).hexdigest())
        return out

    return _mapped(df, rank_path, pattern, text, "n_tokens:bigint ids_sha256:string decoded_sha256:string", work)


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.lit("byte_bpe_multi_50k").alias("vocabulary"))
