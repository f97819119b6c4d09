"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans (assignments, access identifiers, long hex runs) are reported as they stand. Weak
candidates (random-looking words) are reported only where a complementary part lies within the same
scope, an interval of code points around the candidate: an access identifier, the name of a key, or
a login name together with an endpoint.

Texts that hold a candidate and a part are joined by intervals: places of parts and candidates meet in
cells as wide as the scope, of one distinct text each, so a cell holds few of them however long the
text is, and copies are looked at once. All other texts move nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: parts that link: words that name a credential, addresses, and random-looking words
NAME = r"\b(?:client_id|client_secret|access_key|account|username|login|credential|bearer|passphrase|private_key)\b"
#: the same words in either case and inside longer names: those of keys, and those of logins
KEY = r"(?i:client[_-]?secret|access[_-]?key|credential|bearer|passphrase|private[_-]?key)"
LOGIN = r"(?i:client[_-]?id|username|login|account(?!able|abil|ant|ed|ing))"
ENDPOINT = r"(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])"
KINDS = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"
#: elements that are folded into one array at a time: an array is copied at each step that adds to it
BLOCK = 128


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def _fold(given: Column, zero: Column, kind: str, after: Callable, told: Callable, within: Callable | None = None) -> Column:
    """What told(state, item, within, first state) gives for each item of given, where after(state, item) is the next state.

    Blocks are passed over twice, for the state before each and for what is told, so the work is about
    linear in the items. within(first state, last state) is worked out once per block.
    """
    begin = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    states = lambda b: F.aggregate(b, begin, lambda s, x: F.struct(F.aggregate(x, s["at"], after).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: F.concat(s["out"], F.array(s["at"])))

    def block(b: Column, low: Column, high: Column) -> Column:
        def run(w: Column) -> Column:
            start = F.struct(low.alias("at"), F.array().cast(kind).alias("out"))
            return F.aggregate(b, start, lambda s, x: F.struct(after(s["at"], x).alias("at"), F.concat(s["out"], told(s["at"], x, w, low)).alias("out")), lambda s: s["out"])

        return _let(within(low, high) if within else F.lit(0), run)

    def whole(b: Column) -> Column:
        return _let(states(b), lambda at: F.flatten(F.transform(F.arrays_zip(b.alias("b"), F.slice(at, F.lit(1), F.size(b)).alias("low"), F.slice(at, F.lit(2), F.size(b)).alias("high")), lambda z: block(z["b"], z["low"], z["high"]))))

    def of(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(items) > 0, _let(blocks, whole)).otherwise(F.array().cast(kind))

    return _let(given, of)


def _places(text: Column, pattern: str, rank: int, kind: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches of pattern with their places, where gate holds.

    What lies between matches and the matches themselves alternate, so running sums of their lengths
    are the places.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def of(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("0"), found.alias("1"))
        sizes = F.transform(pairs, lambda p: F.struct(F.length(p["0"]).alias("gap"), F.length(p["1"]).alias("size")))

        def told(at: Column, x: Column, _: Column, __: Column) -> Column:
            start = at + x["gap"]
            return F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["size"]).alias("stop")))

        return _fold(sizes, F.lit(0).cast("long"), SPAN, lambda at, x: at + x["gap"] + x["size"], told)

    return F.when(gate, _let(found, of)).otherwise(F.array().cast(SPAN))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _base(text: Column) -> Column:
    """Struct of the strong spans by kind."""
    low = F.lower(text)
    named = [low.contains(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")]
    value = F.regexp_extract_all(text, F.lit(ASSIGN), 1)
    gate = named[0]
    for more in named[1:]:
        gate = gate | more
    assign = F.filter(
        F.arrays_zip(_places(text, ASSIGN, 0, "assign", gate).alias("span"), F.when(gate, value).otherwise(F.array().cast("array<string>")).alias("value")),
        lambda p: F.length(p["value"]) >= 6,
    )
    access = F.filter(_places(text, ACCESS, 1, "access", text.contains("AKIA")), lambda s: s["stop"] - s["start"] >= 20)
    # runs are maximal, so those under 24 characters can be skipped by the pattern itself
    hex_ = _places(text, HEX + "(?<=[0-9a-f]{24})", 2, "hex", text.rlike("[0-9a-f]{24}"))
    # bound as one value, so that no column that reads a part of it searches the text again
    return _let(F.struct(F.transform(assign, lambda p: p["span"]).alias("assign"), access.alias("access"), hex_.alias("hex")), lambda f: f)


def _linked(texts: DataFrame, scope: int) -> DataFrame:
    """(print, weak): of distinct texts (print, text), the weak candidates with a complementary part in scope.

    No strong span or endpoint overlaps them. A part inside a candidate is none of its parts, and a
    candidate that holds a name is one itself; words of NAME that stand alone, beside an endpoint, count
    wherever they are.
    """
    text, always = F.col("text"), F.lit(True)
    kinds = {"weak": OPAQUE, "name": NAME, "key": KEY, "login": LOGIN, "end": ENDPOINT}
    found = F.concat(F.col("base.assign"), F.col("base.access"), F.col("base.hex"), *(_places(text, p, 3, k, always) for k, p in kinds.items()))
    at = texts.withColumn("base", _base(text)).select("print", F.explode(found).alias("s")).select("print", "s.kind", "s.start", "s.stop")
    cell = F.floor(F.col("start") / scope)
    last = F.floor((F.col("stop") - 1) / scope)
    cells = F.when(F.col("kind") == "weak", F.sequence(cell - 1, F.greatest(cell + 1, last))).otherwise(F.sequence(cell, last))
    met = at.select("*", cell.alias("home"), F.explode(cells).alias("cell"))
    own = F.col("home") == F.col("cell")
    parts = ("access", "name", "key", "login", "end")
    ends = [f(F.when((F.col("kind") == k) & own, F.col("start"))).alias(f"{n}_{k}") for k in parts for f, n in ((F.min, "min"), (F.max, "max"))]
    spans = lambda *kinds: F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("start", "stop")))
    # a cell is as wide as the scope and places of a kind do not overlap, so its lists are short
    together = met.groupBy("print", "cell").agg(*ends, spans("weak").alias("weak"), spans("assign", "access", "hex", "end").alias("others"), spans("key", "login").alias("names"))
    each = together.withColumn("w", F.explode("weak")).withColumn("home", F.floor(F.col("w.start") / scope))
    # parts of the cell itself and of its neighbours, never of one farther on that the candidate reaches into
    near = lambda k: F.coalesce((F.abs(F.col("home") - F.col("cell")) <= 1) & (F.col(f"min_{k}") <= F.col("w.start") + scope) & (F.col(f"max_{k}") >= F.col("w.start") - scope), F.lit(False))
    over = lambda c: F.exists(c, lambda x: (x["start"] < F.col("w.stop")) & (x["stop"] > F.col("w.start")))
    seen = each.select("print", "w", *(near(k).alias(k) for k in parts), over("others").alias("blocked"), over("names").alias("named"))
    one = seen.groupBy("print", "w").agg(*(F.max(c).alias(c) for c in (*parts, "blocked", "named")))
    has = {c: F.col(c) for c in parts}
    alone = has["end"] & (has["name"] | has["access"])
    joint = (has["access"] | has["key"] | (has["end"] & has["login"])) & ~F.col("named")
    span = F.struct(F.col("w.start").alias("start"), F.lit(3).alias("rank"), F.lit("weak").alias("kind"), F.col("w.stop").alias("stop"))
    return one.where(~F.col("blocked") & (alone | joint)).groupBy("print").agg(F.array_sort(F.collect_list(span)).alias("weak"))


def _found(docs: DataFrame, keep: list[Column], scope: int) -> DataFrame:
    """(row, text, assign, access, hex, weak) for each row of docs; row is a struct of keep, null text is empty."""
    text = F.col("text").cast("string")
    given = docs.select(F.struct(*keep).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    # only texts with a part and a candidate can link; the test is cheap and made twice
    parts = F.col("text").contains("AKIA") | F.col("text").rlike(f"{KEY}|{LOGIN}")
    doubtful = parts & F.col("text").rlike(OPAQUE)
    some = given.where(doubtful).withColumn("print", F.sha2("text", 256))
    linked = _linked(some.select("print", "text").groupBy("print").agg(F.first("text").alias("text")), scope)
    joined = some.join(linked.hint("merge"), "print", "left").select("row", "text", F.coalesce("weak", F.array().cast(SPAN)).alias("weak"))
    whole = given.where(~doubtful).select("row", "text", F.array().cast(SPAN).alias("weak")).unionByName(joined)
    return whole.select("row", "text", _base(F.col("text")).alias("f"), "weak").select("row", "text", "f.*", "weak")


def scanned(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak.

    Null text is empty. Rows that share an id, or have none, are scanned each for itself; equal texts
    have equal spans. `scope` is the largest distance, in code points between starts, at which parts
    link. Long texts take about linear time, but for one array of all their spans.
    """
    found = _found(docs, [F.col("doc_id")], scope)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_digest(base), 256).alias("base_sha256"),
        _digest(F.array_sort(F.concat("assign", "access", "hex", "weak"))).alias("spans"),
        F.size("weak").cast("long").alias("n_weak"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """docs with every span of its texts replaced by mark, and n_chars (if there) brought up to date.

    Spans that overlap are replaced as one. Null text stays null.
    """
    names = docs.columns
    found = _found(docs, [F.col(c).alias(f"_keep{i}") for i, c in enumerate(names)], scope)
    text = F.col("text")

    def told(at: Column, s: Column, part: Column, low: Column) -> Column:
        gap = F.substr(part, (at - low + 1).cast("int"), (s["start"] - at).cast("int"))
        return F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(F.array(gap, F.lit(mark)))

    def rebuilt(spans: Column) -> Column:
        cut = lambda low, high: F.substr(text, (low + 1).cast("int"), (high - low).cast("int"))
        pieces = _fold(spans, F.lit(0).cast("long"), "array<string>", lambda at, s: F.greatest(at, s["stop"]), told, cut)
        end = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.concat(F.array_join(pieces, ""), F.substr(text, (end + 1).cast("int")))

    spans = F.array_sort(F.concat("assign", "access", "hex", "weak"))
    clean = F.when(F.size(spans) == 0, text).otherwise(_let(spans, rebuilt))
    out = found.select("row", clean.alias("clean"))
    at = {c: F.col(f"row._keep{i}") for i, c in enumerate(names)}
    at["text"] = F.when(at["text"].isNotNull(), F.col("clean"))
    if "n_chars" in names:
        at["n_chars"] = F.length(at["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(at[c].alias(c) for c in names))
