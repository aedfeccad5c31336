"""Alignment of two tokenizers over a corpus: where their tokens end together, and which ids meet there.

Texts are shuffled by their whole content, so each distinct text is tokenised and aligned
once; its links count as often as it has copies.  A task cuts texts before blanks where
neither tokenizer has a token across, and each distinct part is encoded and aligned once
for many texts.  Texts leave as segments: numbers of parts, the parts' id pairs and the
pairs' counts.  Counts of pairs are summed over all segments, and each segment then gets
the totals of its own pairs back, once each, however often its texts hold them.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm.common import flat, saved, slices, table, trim, unclashed
from codelake.llm.order import attached
from codelake.llm.registry import query

#: Bytes of text in a segment; a longer text is in one of its own.
SEGMENT_BYTES = 8 << 20
#: Bytes of distinct parts after which a task forgets them, and of those that are encoded as one text.
PARTS_BYTES, RUN_BYTES = 2 << 20, 1 << 14


# ---------------------------------------------------------------- two tokenizers


def byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Pair:
    """Byte-level BPE (A, over a blank and the text) beside a piece model with byte fallback (B, which adds the blank)."""

    def __init__(self, a_file: bytes, b_file: bytes, cut: bool = True):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        letters = byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(k) or "" for k in range(size)]
        # an added entry may hold letters outside of the byte alphabet; plain texts never give it
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        # a piece with a blank behind another letter would lie across a cut
        self.cut = cut and not any(" " in t.lstrip(" ") for t in (p.replace("▁", " ") for p in pieces))

        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids as text with what follows them: another of their kind, or the group's end
        self.spelled = np.array([f"{k}{end}" for n, more in ((size, ",|"), (len(pieces), ",;")) for end in more for k in range(n)], object)

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for texts that open with the blank."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return a, [ids if t != " " else [self.blank] for t, ids in zip(texts, b, strict=True)]

    def flat_ids(self, parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the parts in another order, ids of A behind one another, how many each part has, the same of B).

        Parts that end before a cut are encoded in runs, as one text, and dealt out by the
        bytes of their tokens; if a run doesn't come back byte for byte, its parts go one by one.
        """
        runs, alone, size = [[]], [], 0
        for part in parts:
            if self.cut and 0x20 < part[-1] < 0x7F:
                runs[-1].append(part)
                size += len(part)
                if size >= RUN_BYTES:
                    runs.append([])
                    size = 0
            else:
                alone.append(part)
        order, flat, counts = [], ([], []), ([], [])
        for run in filter(None, runs):
            whole = b"".join(run)
            ids = [x[0] for x in self.ids([whole.decode(errors="replace")])]
            if self.spell(*ids) != (whole, whole):
                alone += run
                continue
            order += run
            ends = np.cumsum([len(p) for p in run])
            for k, (own, width) in enumerate(zip(ids, (self.a_size, self.b_size), strict=True)):
                own = np.array(own, np.int64)
                flat[k].append(own)
                counts[k].append(np.diff(np.searchsorted(np.cumsum(width[own]), ends, side="right"), prepend=0))
        order += alone
        if alone:
            for k, own in enumerate(self.ids([p.decode(errors="replace") for p in alone])):
                flat[k].append(np.fromiter(chain.from_iterable(own), np.int64))
                counts[k].append(np.fromiter(map(len, own), np.int64, len(own)))
        a, b, n_a, n_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (*flat, *counts))
        return order, a, n_a, b, n_b

    def spell(self, a, b) -> tuple[bytes, bytes]:
        return b"".join(map(self.a_bytes.__getitem__, a)), b"".join(map(self.b_bytes.__getitem__, b))


_PAIRS: dict[tuple, Pair] = {}


def pair_of(a_file: bytes, b_file: bytes, cut: bool) -> Pair:
    """One pair of tokenizers per Python process."""
    key = (hashlib.sha256(a_file).digest(), hashlib.sha256(b_file).digest(), cut)
    if key not in _PAIRS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        _PAIRS[key] = Pair(a_file, b_file, cut)
    return _PAIRS[key]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts start: at each text, and before a blank behind printable ASCII or a two-byte letter from U+00C0 on.

    Byte-level BPE splits there, since such a letter is no white space; pieces hold blanks
    in front alone.
    """
    start = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before, lead = data[1:-1], data[:-2]
        solid = (before > 0x20) & (before < 0x7F) | (before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead <= 0xDF)
        start[2:-1] = solid & (data[2:] == 0x20)
        start[1] |= 0x20 < data[0] < 0x7F and data[1] == 0x20
    start[offsets] = True
    start[len(data)] = False
    return np.flatnonzero(start)


class Parts:
    """Distinct parts by number, with their measures, groups as text, and links as (A id, B id) in one number."""

    def __init__(self, pair: Pair):
        self.pair, self.number, self.bytes, self.written = pair, {}, 0, []
        # per part: tokens of A and B, links, and whether both give the part back; the links of all behind one another
        self._measures, self._links = [np.zeros((4, 0), np.int64)], [np.zeros(0, np.int64)]

    def measures(self) -> np.ndarray:
        self._measures = [np.concatenate(self._measures, axis=1)]
        return self._measures[0]

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links of the parts behind one another, how many each has)."""
        self._links = [np.concatenate(self._links)]
        n = self.measures()[2]
        first, size = (np.cumsum(n) - n)[numbers], n[numbers]
        return self._links[0][np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    def add(self, parts: list[bytes]) -> None:
        """Encode and align new parts, all at once: ends of tokens are places in one long string."""
        pair = self.pair
        parts, a, n_a, b, n_b = pair.flat_ids(parts)
        size = np.array([len(p) for p in parts], np.int64)
        sound = np.ones(len(parts), bool)
        if pair.spell(a.tolist(), b.tolist()) != (b"".join(parts),) * 2:
            cut_a, cut_b = (np.append(0, np.cumsum(n)).tolist() for n in (n_a, n_b))
            spelled = (pair.spell(a[cut_a[k] : cut_a[k + 1]].tolist(), b[cut_b[k] : cut_b[k + 1]].tolist()) for k in range(len(parts)))
            sound = np.array([x == y == p for (x, y), p in zip(spelled, parts, strict=True)])
            a, b = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)]
            n_a, n_b, size = n_a * sound, n_b * sound, size * sound
        ends_a, ends_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.isin(ends_a, shared, assume_unique=True), np.isin(ends_b, shared, assume_unique=True)
        links = a[last_a] << 32 | b[last_b]  # in a group, the last token of each ends with the other
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        tables = len(pair.a_size), len(pair.b_size)
        texts = pair.spelled[np.concatenate([a + last_a * tables[0], 2 * tables[0] + b + last_b * tables[1]])[order]].tolist()
        ends = np.cumsum(n_a + n_b).tolist()
        groups = np.diff(np.searchsorted(shared, np.cumsum(size), side="right"), prepend=0)
        at = 0
        for k, part in enumerate(parts):
            self.number[part] = len(self.written)
            self.written.append("".join(texts[at : ends[k]])[:-1])
            at = ends[k]
        self._measures.append(np.stack([n_a, n_b, groups, sound]))
        self._links.append(links)
        self.bytes += sum(map(len, parts))

    def of_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's parts by number; none for a text without tokens."""
        spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts.fill_null(""), pa.scalar(" ", texts.type))
        data, offsets = flat(spaced)
        starts = cuts(data, offsets) if self.pair.cut else offsets[:-1]
        whole = data.tobytes()
        pieces = [whole[x:y] for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(whole)], strict=True)]
        new = [p for p in dict.fromkeys(pieces) if p not in self.number]
        if new:
            self.add(new)
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        bounds = np.searchsorted(starts, offsets)
        out, none = [], np.zeros(0, np.int64)
        sound = self.measures()[3][numbers] > 0
        for x, y, p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = numbers[x:y] if q - p > 1 else none
            if not sound[x:y].all():
                # cut or not, what the whole text's tokens spell decides
                if y - x > 1 and whole[p:q] not in self.number:
                    self.add([whole[p:q]])
                k = self.number[whole[p:q]]
                own = np.array([k]) if self.measures()[3][k] else none
            out.append(own)
        return out


# ---------------------------------------------------------------- segments

_SEGMENT = "seg bigint, names binary, copies binary, n_a binary, n_b binary, n_groups binary, written binary, texts binary, parts binary, part_ends binary, part_links binary, pairs binary, counts binary"


def _packed(seg: int, parts: Parts, names: list[bytes], copies: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in own], np.int64)
    numbers, local = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True)
    links, n_links = parts.links_of(numbers)
    pairs, at = np.unique(links, return_inverse=True)
    ends = np.append(0, np.cumsum(sizes))
    sums = lambda v: np.diff(np.append(0, np.cumsum(v[local]))[ends])
    n_a, n_b, groups = (sums(v) for v in parts.measures()[:3, numbers])
    written = [hashlib.sha256(";".join([parts.written[k] for k in x.tolist()]).encode()).digest() if len(x) else bytes(32) for x in own]
    often = np.zeros(len(numbers), np.int64)
    np.add.at(often, local, np.repeat(np.array(copies, np.int64), sizes))
    counts = np.zeros(len(pairs), np.int64)
    np.add.at(counts, at, np.repeat(often, n_links))
    values = [b"".join(names), np.array(copies, np.int64), n_a, n_b, groups, b"".join(written), sizes, local.astype(np.uint32), np.cumsum(n_links), at.astype(np.uint32), pairs, counts]
    return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), *[pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for v in values]], names=[f.split()[0] for f in _SEGMENT.split(", ")])


def segments_of(texts: DataFrame, a_file: str, b_file: str, cut: bool = True, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Distinct ``texts`` (text, name, copies) as packed segments; both files are read by the driver alone (a few MB)."""
    files = []
    for path in (a_file, b_file):
        with open(path, "rb") as f:
            files.append(f.read())
    shared = texts.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        pair = pair_of(*shared.value, cut)
        parts, names, copies, own, size = Parts(pair), [], [], [], 0
        seg = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                own += parts.of_texts(part.column("text"))
                names += part.column("name").to_pylist()
                copies += part.column("copies").to_pylist()
                size += part.column("text").nbytes
                if size >= segment_bytes:
                    yield _packed(seg, parts, names, copies, own)
                    names, copies, own, size, seg = [], [], [], 0, seg + 1
                    if parts.bytes > PARTS_BYTES:
                        parts = Parts(pair)
                    trim()
        if names:
            yield _packed(seg, parts, names, copies, own)

    return texts.select("text", "name", "copies").mapInArrow(run, _SEGMENT)


def _pairs(segments: DataFrame) -> DataFrame:
    """(seg, pair, n): each pair of a segment once."""
    def run(batches):
        for batch in batches:
            for seg, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("seg", "pairs", "counts")), strict=True):
                values = np.frombuffer(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), seg)), pa.array(values), pa.array(np.frombuffer(counts, np.int64))], names=["seg", "pair", "n"])

    return segments.select("seg", "pairs", "counts").mapInArrow(run, "seg bigint, pair bigint, n bigint")


def _totals(segments: DataFrame) -> DataFrame:
    """(pair, total, best): how often each pair is linked, and whether no pair of its B id is so more often.

    A B id has at most one pair for each A id, so the vocabulary bounds its rows.
    """
    counted = _pairs(segments).groupBy("pair").agg(F.sum("n").alias("total"))
    each = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return counted.select("pair", "total", (F.col("total") == F.max("total").over(each)).alias("best"))


def _measured(segment: pa.Table, totals: pa.Table) -> pa.Table:
    """A segment's texts with their measures, from the totals of its pairs."""
    get = lambda c, kind=np.int64: np.frombuffer(segment.column(c)[0].as_py(), kind)
    names, written = segment.column("names")[0].as_py(), segment.column("written")[0].as_py()
    pairs, of = get("pairs"), totals.column("pair").to_numpy()
    by = np.argsort(of)
    if not np.array_equal(of[by], pairs):
        raise RuntimeError("totals and pairs of a segment differ")
    links, part_ends, parts, ends = get("part_links", np.uint32), get("part_ends"), get("parts", np.uint32), np.append(0, np.cumsum(get("texts")))

    def summed(values):
        by_part = np.diff(np.append(0, np.cumsum(values[links]))[np.append(0, part_ends)])
        return np.diff(np.append(0, np.cumsum(by_part[parts]))[ends])

    n = len(ends) - 1
    digests = [written[32 * k : 32 * k + 32].hex() if some else "" for k, some in enumerate(np.diff(ends) > 0)]
    groups = get("n_groups")
    return pa.table({
        "name": pa.array([names[32 * k : 32 * k + 32] for k in range(n)], pa.binary()), "copies": get("copies"), "n_a": get("n_a"), "n_b": get("n_b"), "n_groups": groups,
        "n_links": groups, "n_best": summed(totals.column("best").to_numpy(zero_copy_only=False)[by].astype(np.int64)),
        "count_sum": summed(totals.column("total").to_numpy()[by]), "groups_sha256": pa.array(digests, pa.string())})


def _distinct(docs: DataFrame, text: str) -> DataFrame:
    """(text, copies, name): each distinct text once, in tasks of about a segment, however many partitions a shuffle has."""
    whole = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = whole.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    texts = whole.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).coalesce(max(1, -(-size // SEGMENT_BYTES)))
    return texts.withColumn("name", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def pair_counts(df: DataFrame, a_file: str, b_file: str, text: str = "text", cut: bool = True) -> DataFrame:
    """(a_id, b_id, total, best) of all pairs of ids whose tokens end together somewhere in the corpus."""
    counted = _totals(saved(segments_of(_distinct(df, text), a_file, b_file, cut)))
    return counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "total", "best")


def align(df: DataFrame, a_file: str, b_file: str, text: str = "text", cut: bool = True, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """All rows, the text left out, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Both tokenizers read a blank and the whole text; names of special tokens in it are plain
    text.  Places where tokens of both end part the tokens into groups, and the two that
    end there are linked.  ``n_best`` counts links whose pair no pair of its B id exceeds in
    the corpus (ties count); ``count_sum`` adds up the pairs' counts over the links.  A null
    or empty text, and one that either tokenizer doesn't give back byte for byte, has zeros
    and an empty ``groups_sha256``.  Copies and repeated rows have equal measures, each
    counts.  A very long text is one segment; what a task holds grows with it.  ``cut``
    False encodes texts whole, for a byte-level tokenizer that doesn't split before blanks.
    An empty table gives an empty one; columns with the new names are replaced, and no other
    name clashes.  The two files (some MB) are read by the driver.
    """
    frame = unclashed(df, [c for c in MEASURES if c != text])
    segments = saved(segments_of(_distinct(frame, text), a_file, b_file, cut, segment_bytes))
    totals = saved(_totals(segments))
    own = _pairs(segments).select("seg", "pair").join(totals, "pair")
    measures = ", ".join(f"{c} bigint" for c in MEASURES[:-1])
    # a segment without links has no totals: its rows come by the other side of the cogroup
    measured = segments.groupBy("seg").cogroup(own.groupBy("seg")).applyInArrow(_measured, f"name binary, copies bigint, {measures}, groups_sha256 string")
    values = saved(measured)
    n_rows = values.agg(F.sum("copies").alias("n")).collect()[0]["n"] or 0
    keep = [c for c in frame.columns if c != text]
    held = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    docs = frame.select(held.alias("row"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)).alias("name"))
    done = attached(docs, values, "name", "copies", n_rows)
    return done.select(*[F.col(f"row.`{c}`") for c in keep], *MEASURES)


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
