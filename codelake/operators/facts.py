"""Java code facts as tables: types, imports, methods, constructors, variables, calls.

The extraction is a chain of column expressions over one file per row: comments and
literals are blanked, the text is cut into statements at ``;``, ``{`` and ``}``, and
regexes classify each statement.  No step shuffles, and no step leaves the JVM.
It reads declarations as they are written in ordinary sources; it is not a compiler.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.session import checkpoint

CALLED = "\u0004"
ANNOS = "((?:@\\w+(?:\\([^()]*\\))?\\s*)*)"
MODS = "((?:(?:public|protected|private|static|final|abstract|default|synchronized|native|sealed|non-sealed|strictfp)\\s+)*+)"
NOT_TYPE = "(?!(?:return|new|throw|else|package|import|case|assert|yield|extends|implements|throws|do|try|if|for|while|switch)\\b)"
TYPE_RX = f"^{ANNOS}{MODS}(class|interface|enum|record|@interface)\\s+(\\w+)(.*)$"
METHOD_RX = f"^{ANNOS}{MODS}{NOT_TYPE}([\\w.$]+(?:\\[\\])*)\\s+(?!(?:if|for|while|switch|catch)\\b)(\\w+)\\s*\\((.*)\\)\\s*(?:throws [\\w., ]+)?$"
CTOR_RX = f"^{ANNOS}{MODS}(?!(?:if|for|while|switch|catch|synchronized|try|super|this|return)\\b)(\\w+)\\s*\\((.*)\\)\\s*(?:throws [\\w., ]+)?$"
VAR_RX = f"^{ANNOS}{MODS}{NOT_TYPE}([\\w.$]+(?:\\[\\])*)\\s+(\\w+)\\s*(?:=.*)?$"
CALL_RX = (
    f"(?:(?<![\\w$.{CALLED}])((?:new\\s+)?(?:[\\w${CALLED}]+\\s*\\.\\s*)*[\\w$]+)\\s*"
    f"|(?<![\\w$.{CALLED}]\\s{{0,3}}))\\(([^()]*)\\)"
)
NOT_CALLS = ["if", "for", "while", "switch", "catch", "synchronized", "return", "super", "this", "try", "assert", "throw", ""]


def _blank_blocks(code: Column) -> Column:
    """What stands between triple quotes becomes an empty string with the same line breaks; an unclosed block stays."""
    plain = F.regexp_replace(code, "\\\\.", "")  # an escaped quote ends nothing
    pieces = F.split(plain, '"""', -1)
    inside = lambda i: (i % 2 == 1) & (i < F.size(pieces) - 1)
    blank = F.transform(pieces, lambda p, i: F.when(inside(i), F.concat(F.lit('""'), F.regexp_replace(p, "[^\n]", ""))).otherwise(p))
    return F.array_join(blank, "")


def blank_comments(code: Column) -> Column:
    """Empty string and char literals and text blocks, remove comments, keep every line break."""
    c = F.when(code.contains('"""'), _blank_blocks(code)).otherwise(code)
    c = F.regexp_replace(c, '"(?:\\\\.|[^"\\\\\n])*"', '""')
    c = F.regexp_replace(c, "'(?:\\\\.|[^'\\\\\n])'", "' '")
    c = F.regexp_replace(c, "//(?<![:*/]//)[^\n]*", "")

    def after_opening(p):
        end = F.instr(p, "*/")
        body = F.when(end > 0, F.substr(p, F.lit(1), end - 1)).otherwise(p)
        rest = F.when(end > 0, F.substr(p, end + 2, F.length(p))).otherwise("")
        return F.concat(F.regexp_replace(body, "[^\n]", ""), rest)

    pieces = F.split(c, "/\\*", -1)
    c = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(after_opening(p))), "")
    return F.regexp_replace(c, "//[^\n]*", "")


def strip_type_args(text: Column) -> Column:
    """Without type arguments, as deep as the text nests them: each round removes the innermost."""
    step = lambda d, c: F.struct(
        (d["now"] + F.when(c == "<", 1).otherwise(-1)).alias("now"), F.greatest(d["most"], d["now"] + F.when(c == "<", 1).otherwise(-1)).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    depth = F.aggregate(F.regexp_extract_all(text, F.lit("([<>])"), 1), start, step)["most"]
    inner = "<[\\w\\s,.?&\\[\\]@$]*>"
    flat = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), text, lambda t, _: F.regexp_replace(t, inner, ""))
    return F.when(text.contains("<"), flat).otherwise(text)


def _segments(code: Column) -> Column:
    # Runs of blanks become one, at line breaks none, so a statement's lines are counted by its line breaks.
    code = F.regexp_replace(code, "[ \\t\\x0B\\f\\r]+", " ")
    for near in (" \n", "\n "):
        code = F.replace(code, F.lit(near), F.lit("\n"))
    raw = F.regexp_extract_all(code, F.lit("[^;{}]*[;{}]"), 0)

    def one(s):
        text = F.btrim(F.replace(F.left(s, F.length(s) - 1), F.lit("\n"), F.lit(" ")))
        return F.struct(
            (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).alias("breaks"), (F.length(s) - F.length(F.ltrim(s, F.lit("\n")))).alias("before"),
            F.when(text.contains("  "), F.regexp_replace(text, " +", " ")).otherwise(text).alias("text"), F.right(s, F.lit(1)).alias("term"))

    # Lambdas share nothing with each other, so every costly value gets its own pass.
    keep = lambda s: [s[n].alias(n) for n in ("breaks", "before", "text", "term")]
    kinds = lambda s: reduce(Column.__or__, [s["flat"].contains(k) for k in ("class ", "interface ", "enum ", "record ")])
    out = F.transform(raw, one)
    out = F.transform(out, lambda s: F.struct(*keep(s), strip_type_args(s["text"]).alias("flat")))
    out = F.transform(out, lambda s: F.struct(*keep(s), s["flat"].alias("flat"), F.when(kinds(s), F.regexp_extract(s["flat"], TYPE_RX, 4)).otherwise("").alias("tname")))
    opens = lambda s: F.when(s["term"] == "{", _declared_name(s["flat"], s["tname"])).otherwise("")
    return F.transform(out, lambda s: F.struct(*keep(s), s["flat"].alias("flat"), s["tname"].alias("tname"), opens(s).alias("mname")))


def _declared_name(flat: Column, tname: Column) -> Column:
    """Name of the method or constructor that a statement declares, else empty."""
    method = F.regexp_extract(flat, METHOD_RX, 4)
    callable_ = (tname == "") & flat.endswith(")") | flat.contains(") throws ")
    return F.when(callable_, F.coalesce(F.nullif(method, F.lit("")), F.regexp_extract(flat, CTOR_RX, 3))).otherwise("")


# Walks the statements once, keeping brace depth, the stack of open types and the open method.
# Only braces change these: between them a step copies ``v`` and counts lines.
SCOPE_FOLD = """
aggregate(st,
  named_struct('out', cast(array() as array<struct<line:int,owner:string,method:string,level:int>>), 'line', 1,
    'v', named_struct('depth', 0, 'types', cast(array() as array<struct<n:string,d:int>>), 'n', cast(null as string), 'd', cast(null as int),
                      'm', cast(null as string), 'md', -1)),
  (a, s) -> named_struct(
    'out', array_append(a.out, named_struct('line', a.line + s.before, 'owner', a.v.n,
       'method', if(s.mname != '' and a.v.depth = a.v.d + 1, s.mname, a.v.m),
       'level', a.v.depth - coalesce(a.v.d + 1, 0))),
    'line', a.line + s.breaks,
    'v', case s.term
      when '{' then if(s.tname != '',
        named_struct('depth', a.v.depth + 1, 'types', array_append(a.v.types, named_struct('n', s.tname, 'd', a.v.depth)), 'n', s.tname, 'd', a.v.depth,
                     'm', if(s.mname != '' and a.v.depth = a.v.d + 1, s.mname, a.v.m), 'md', if(s.mname != '' and a.v.depth = a.v.d + 1, a.v.depth, a.v.md)),
        named_struct('depth', a.v.depth + 1, 'types', a.v.types, 'n', a.v.n, 'd', a.v.d,
                     'm', if(s.mname != '' and a.v.depth = a.v.d + 1, s.mname, a.v.m), 'md', if(s.mname != '' and a.v.depth = a.v.d + 1, a.v.depth, a.v.md)))
      when '}' then if(a.v.d >= a.v.depth - 1,
        element_at(transform(array(filter(a.v.types, t -> t.d < a.v.depth - 1)), ts -> named_struct(
                     'depth', a.v.depth - 1, 'types', ts, 'n', try_element_at(ts, -1).n, 'd', try_element_at(ts, -1).d,
                     'm', if(a.v.depth - 1 <= a.v.md, null, a.v.m), 'md', if(a.v.depth - 1 <= a.v.md, -1, a.v.md))), 1),
        named_struct('depth', a.v.depth - 1, 'types', a.v.types, 'n', a.v.n, 'd', a.v.d,
                     'm', if(a.v.depth - 1 <= a.v.md, null, a.v.m), 'md', if(a.v.depth - 1 <= a.v.md, -1, a.v.md)))
      else a.v end),
  a -> a.out)
"""


def statements(files: DataFrame) -> DataFrame:
    """One row per statement of every Java file, with its line and scope."""
    # No filter: Spark would move it, and with it whatever makes the content, below the caller's repartition.
    java = F.lower("path").endswith(".java") & (F.trim("content") != "")
    code = F.when(java, blank_comments(F.col("content")))
    # Braces of annotation arrays would cut the annotation apart.
    code = F.regexp_replace(code, "(@\\w+\\s*\\([^(){}]*)\\{([^{}()]*)\\}", "$1[$2]")
    parsed = (
        files.select("project_id", "path", code.alias("code"))
        .withColumn("package", F.regexp_extract("code", "(?m)^\\s*package\\s+([\\w.]+)\\s*;", 1))
        .withColumn("st", _segments(F.col("code")))
        .withColumn("sc", F.expr(SCOPE_FOLD))
    )
    rows = F.arrays_zip("st", "sc")
    # Inside of bodies no statement without a block declares a method.
    mname = F.when((F.col("z.sc.level") == 0) & (F.col("z.st.term") != "{"), _declared_name(F.col("z.st.flat"), F.col("z.st.tname"))).otherwise(F.col("z.st.mname"))
    return parsed.select("project_id", "path", "package", F.posexplode(rows).alias("pos", "z")).select(
        "project_id", "path", "package", "pos", "z.sc.line", "z.st.text", "z.st.term", "z.st.flat", "z.st.tname", mname.alias("mname"), "z.sc.owner", "z.sc.method", "z.sc.level")


def simple(col: Column) -> Column:
    return F.substring_index(col, ".", -1)


def _names(text: Column, word: str, stop: str) -> Column:
    part = F.regexp_extract(text, f"\\b{word} ([\\w., ]+?)(?= (?:{stop})\\b|\\s*$)", 1)
    return F.filter(F.transform(F.split(part, ",", -1), lambda x: simple(F.trim(x))), lambda x: x != "")


def _annotations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("@(\\w+)"), 1)


def _groups(text: Column, rx: str, *groups: int) -> Column:
    """Groups of a pattern that spans a whole text, by one match; they stand in an array."""
    return F.split(F.regexp_replace(text, rx, "\u0005".join(f"${i}" for i in groups)), "\u0005", -1)


def _named() -> Column:
    """Only such statements can match the patterns of methods and constructors: a name was found, or a blank lacks before ``throws``."""
    return (F.col("mname") != "") | F.col("flat").contains(")throws ")


def types(st: DataFrame) -> DataFrame:
    g = lambda i: F.regexp_extract("flat", TYPE_RX, i)
    kind = F.upper(F.when(g(3) == "@interface", "annotation").otherwise(g(3)))
    ext = _names(g(5), "extends", "implements|permits")
    impl = _names(g(5), "implements", "permits|extends")
    return st.filter((F.col("tname") != "") & (F.col("term") == "{")).select(
        "project_id", "path", "package", "pos", "line", F.col("tname").alias("name"), "owner",
        F.concat_ws(".", F.nullif("package", F.lit("")), F.col("tname")).alias("fqn"),
        kind.alias("kind"), g(2).rlike("\\bpublic\\b").alias("is_public"), g(2).rlike("\\babstract\\b").alias("is_abstract"),
        F.array_distinct(F.regexp_extract_all(g(2), F.lit("([\\w-]+)"), 1)).alias("modifiers"),
        _annotations(g(1)).alias("annotations"), ext.alias("extends"), impl.alias("implements"),
        F.col("owner").isNull().alias("top_level"),
        F.when(g(3) == "record", F.regexp_extract(g(5), "^\\s*\\((.*?)\\)", 1)).alias("record_params"))


def imports(st: DataFrame) -> DataFrame:
    rx = "^import (static )?([\\w.]+?)(\\.\\*)?$"
    return st.filter(F.col("text").rlike(rx) & (F.col("term") == ";")).select(
        "project_id", "path", "package", "pos", "line", F.regexp_extract("text", rx, 2).alias("name"),
        (F.regexp_extract("text", rx, 1) != "").alias("is_static"), (F.regexp_extract("text", rx, 3) != "").alias("wildcard"))


def _params(text: Column) -> Column:
    """Parameter list to ``array<struct<type, name>>`` without annotations and modifiers."""
    clean = lambda p: F.regexp_replace(F.trim(p), "^(?:@\\w+(?:\\([^()]*\\))?\\s+|final\\s+)*", "")
    rx = "^([\\w.$]+)\\s*((?:\\[\\])*)(?:\\.\\.\\.)?\\s*(\\w*)"
    return F.transform(
        F.filter(F.split(text, ",", -1), lambda p: F.trim(p) != ""),
        lambda p: F.struct(
            F.concat(simple(F.regexp_extract(clean(p), rx, 1)), F.when(F.regexp_extract(clean(p), rx, 2) != "", "[]").otherwise("")).alias("type"),
            F.regexp_extract(clean(p), rx, 3).alias("name")))


def _type_name(text: Column) -> Column:
    return F.concat(simple(F.regexp_replace(text, "(\\[\\])+$", "")), F.when(text.endswith("[]"), "[]").otherwise(""))


def methods(st: DataFrame) -> DataFrame:
    decl = (F.col("level") == 0) & F.col("owner").isNotNull() & (F.col("tname") == "") & F.col("term").isin("{", ";") & _named() & F.col("flat").rlike(METHOD_RX)
    g = lambda i: F.get("g", F.lit(i - 1))
    return st.filter(decl).withColumn("g", _groups(F.col("flat"), METHOD_RX, 1, 2, 3, 4, 5)).withColumn("params", _params(g(5))).select(
        "project_id", "path", "package", "pos", "line", "owner", g(4).alias("name"), F.size("params").alias("arity"),
        F.transform("params", lambda p: p["type"]).alias("param_types"), "params", _type_name(g(3)).alias("return_type"),
        _annotations(g(1)).alias("annotations"), F.split(F.trim(g(2)), "\\s+").alias("modifiers"))


def constructors(st: DataFrame) -> DataFrame:
    decl = (F.col("level") == 0) & (F.col("term") == "{") & F.col("flat").contains(F.col("owner")) & _named() & (F.regexp_extract("flat", CTOR_RX, 3) == F.col("owner")) & ~F.col("flat").rlike(METHOD_RX)
    params = _params(F.regexp_extract("flat", CTOR_RX, 4))
    plain = st.filter(decl).withColumn("params", params).select(
        "project_id", "path", "pos", "line", "owner", F.size("params").alias("arity"), "params")
    rec = types(st).filter(F.col("record_params").isNotNull()).withColumn("params", _params(F.col("record_params"))).select(
        "project_id", "path", "pos", "line", F.col("name").alias("owner"), F.size("params").alias("arity"), "params")
    return plain.unionByName(rec)


def _declared_variables(st: DataFrame) -> DataFrame:
    is_var = F.col("owner").isNotNull() & (F.col("tname") == "") & F.col("term").isin(";", "{") & F.col("flat").contains(" ") & F.col("flat").rlike(VAR_RX)
    g = lambda i: F.get("g", F.lit(i))
    return st.filter(is_var).withColumn("g", _groups(F.col("flat"), VAR_RX, 1, 3, 4)).select(
        "project_id", "path", "pos", "line", "owner", g(2).alias("var"), _type_name(g(1)).alias("type"), _annotations(g(0)).alias("annotations"),
        (F.col("level") == 0).alias("is_field"), F.when(F.col("level") == 0, 0).otherwise(2).alias("rank"))


def fields(st: DataFrame) -> DataFrame:
    """The fields among the variables, without a look at what stands in bodies."""
    return _declared_variables(st.filter("level = 0"))


def variables(st: DataFrame, own: DataFrame | None = None, ctors: DataFrame | None = None) -> DataFrame:
    """Fields, parameters and locals with their simple type; ``rank`` orders shadowing."""
    none = F.array().cast("array<string>")
    from_params = lambda df: df.select(
        "project_id", "path", "pos", "line", "owner", F.explode("params").alias("p")).select(
        "project_id", "path", "pos", "line", "owner", F.col("p.name").alias("var"), F.col("p.type").alias("type"), none.alias("annotations"),
        F.lit(False).alias("is_field"), F.lit(1).alias("rank"))
    return _declared_variables(st).unionByName(from_params(methods(st) if own is None else own)).unionByName(from_params(constructors(st) if ctors is None else ctors))


def _all_calls(text: Column) -> Column:
    """Every call of a statement, innermost first, as ``array<struct<callee, args>>``.

    Each round lifts out the calls without nested parentheses and leaves a mark, so a
    chain ``a.b().c()`` keeps its whole path in the last callee.
    """
    start = F.struct(text.alias("t"), F.array().cast("array<string>").alias("c"))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))))

    def step(acc, _):
        return F.struct(
            F.regexp_replace(acc["t"], CALL_RX, f"$1{CALLED}").alias("t"),
            F.concat(acc["c"], F.regexp_extract_all(acc["t"], F.lit(CALL_RX), 0)).alias("c"))

    found = F.aggregate(rounds, start, step, lambda acc: acc["c"])
    parts = F.transform(found, lambda x: F.struct(F.regexp_extract(x, CALL_RX, 1).alias("callee"), F.trim(F.regexp_extract(x, CALL_RX, 2)).alias("args")))
    spaced = lambda c: F.when(c.contains(" "), F.regexp_replace(c, "\\s*\\.\\s*", ".")).otherwise(c)
    return F.transform(parts, lambda p: F.struct(spaced(p["callee"]).alias("callee"), p["args"].alias("args")))


def _call_rows(st: DataFrame) -> DataFrame:
    header = (F.col("tname") != "") | ((F.col("level") == 0) & (F.col("mname") != ""))
    body = F.when(F.col("flat").contains("@"), F.regexp_replace("flat", "@\\w+(?:\\([^()]*\\))?", "")).otherwise(F.col("flat"))
    arity = F.when(F.col("c.args") == "", 0).otherwise(F.size(F.split("c.args", ",", -1)))
    return (
        st.filter(F.col("owner").isNotNull() & ~header & F.col("flat").contains("("))
        .select("project_id", "path", "package", "pos", "line", "owner", "method", F.posexplode(_all_calls(body)).alias("n", "c"))
        .select("project_id", "path", "package", "pos", "n", "line", "owner", "method", "c.callee", "c.args", arity.alias("arity"))
    )


def calls(rows: DataFrame) -> DataFrame:
    """Method calls among the call rows; ``chain`` is the call path ``.a().b()`` that ends in this call."""
    name = F.regexp_extract("callee", "([\\w$]+)$", 1)
    links = F.regexp_extract_all("callee", F.lit(f"([\\w$]+)(?={CALLED}|$)"), 1)
    return rows.filter(~F.col("callee").startswith("new ")).withColumn("name", name).filter(~F.col("name").isin(NOT_CALLS)).select(
        "project_id", "path", "package", "pos", "n", "line", "owner", "method", "name", "arity", "args",
        F.regexp_extract("callee", "^(.*)\\.[\\w$]+$", 1).alias("receiver"),
        F.concat(F.lit("."), F.array_join(links, "()."), F.lit("()")).alias("chain"))


def creations(rows: DataFrame) -> DataFrame:
    """``new T(...)`` with the simple type name and argument count."""
    return rows.filter(F.col("callee").startswith("new ")).select(
        "project_id", "path", "pos", "n", "line", "owner", "method", simple(F.regexp_extract("callee", "^new\\s+([\\w.$]+)$", 1)).alias("type"), "arity")


def type_references(st: DataFrame) -> DataFrame:
    """Unqualified type names used by a statement: declarations, creations, casts, type arguments."""
    g = lambda rx, i: F.regexp_extract("flat", rx, i)
    types_of = lambda params: F.array_join(F.transform(_params(params), lambda p: p["type"]), " ")
    head = F.when(F.col("tname") != "", g(TYPE_RX, 5)).when(
        (F.col("level") == 0) & _named() & F.col("flat").rlike(METHOD_RX), F.concat_ws(" ", g(METHOD_RX, 3), types_of(g(METHOD_RX, 5)))).when(
        (F.col("level") == 0) & (F.col("mname") != ""), types_of(g(CTOR_RX, 4))).when(F.col("flat").contains(" "), g(VAR_RX, 3)).otherwise("")
    among = lambda text, word, rx: F.when(F.col(text).contains(word), F.regexp_extract_all(text, F.lit(rx), 1)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(
        F.array(head),
        among("flat", "new", "\\bnew\\s+([\\w.]+)"),
        among("flat", "instanceof", "\\binstanceof\\s+([\\w.]+)"),
        among("flat", "catch", "\\bcatch\\s*\\(\\s*(?:final\\s+)?([\\w.| ]+)\\s\\w+\\s*\\)"),
        among("flat", "(", "\\(([A-Z]\\w*(?:\\[\\])*)\\)\\s*[\\w(\"]"),
        among("text", "<", "<([\\w\\s,.?&<>\\[\\]]+)>"))
    names = F.array_distinct(F.regexp_extract_all(F.array_join(parts, " ; "), F.lit("(?<![\\w.])([A-Za-z_]\\w*)(?![\\w.])"), 1))
    upper = F.filter(names, lambda x: x.rlike("^[A-Z]"))
    is_import = F.col("text").rlike("^(?:import|package)\\b")
    return (
        st.filter(F.col("text").rlike("[A-Z]") & (F.col("owner").isNotNull() | (F.col("tname") != "")) & ~is_import)
        .select("project_id", "path", "package", "pos", "line", F.explode(upper).alias("name"))
    )


def type_parameters(st: DataFrame) -> DataFrame:
    """Names declared as type variables, per file."""
    on_type = F.regexp_extract("text", "\\b(?:class|interface|record)\\s+\\w+\\s*<(.*?)>\\s*(?:\\(|extends|implements|$)", 1)
    on_method = F.regexp_extract("text", "^(?:@\\w+(?:\\([^()]*\\))?\\s*|\\w+\\s+)*<([^>]+)>\\s+[\\w.<>\\[\\]]+\\s+\\w+\\s*\\(", 1)
    names = F.transform(F.split(F.concat_ws(",", on_type, on_method), ",", -1), lambda x: F.regexp_extract(x, "^\\s*(\\w+)", 1))
    return st.filter(F.col("text").contains("<")).select("project_id", "path", F.explode(names).alias("name")).filter("name != ''").distinct()


class Facts:
    """The fact tables of a corpus, each made when it is first asked for.

    With ``written`` a table that others are made from is written then, so that a check
    which reads it several times extracts it once.
    """

    def __init__(self, statements: DataFrame, written: bool = False):
        self.statements = statements
        self._keep = checkpoint if written else lambda df: df
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table derived from these that several checks read, kept like them."""
        if name not in self._made:
            self._made[name] = self._keep(make())
        return self._made[name]

    @cached_property
    def types(self) -> DataFrame:
        return self._keep(types(self.statements))

    @cached_property
    def imports(self) -> DataFrame:
        return self._keep(imports(self.statements))

    @cached_property
    def methods(self) -> DataFrame:
        return self._keep(methods(self.statements))

    @cached_property
    def constructors(self) -> DataFrame:
        return self._keep(constructors(self.statements))

    @cached_property
    def variables(self) -> DataFrame:
        return self._keep(variables(self.statements, self.methods, self.constructors))

    @cached_property
    def fields(self) -> DataFrame:
        if "variables" in self.__dict__:
            return self.variables.filter("is_field")
        return fields(self.statements)

    @cached_property
    def call_rows(self) -> DataFrame:
        return self._keep(_call_rows(self.statements))

    @cached_property
    def calls(self) -> DataFrame:
        return self._keep(calls(self.call_rows))

    @cached_property
    def creations(self) -> DataFrame:
        return creations(self.call_rows)

    @cached_property
    def type_refs(self) -> DataFrame:
        return self._keep(type_references(self.statements))

    @cached_property
    def type_params(self) -> DataFrame:
        return type_parameters(self.statements)


def extract_facts(files: DataFrame, materialise: bool = True) -> Facts:
    """All fact tables; the statements are written once and read by every table."""
    st = statements(files)
    return Facts(checkpoint(st) if materialise else st, materialise)
