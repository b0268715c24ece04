"""Personal data: base patterns with code-point spans, and bootstrapped contextual extraction beyond them.

Everything is DataFrame functions. Of each text, the matches and the gaps
between them are taken; their lengths give the spans. The base matches are the
seeds. The words around an occurrence are its lexical patterns; patterns and
instances (distinct identifiers) form a graph, whose two sides are scored in
turn: a pattern by the share of its instances that are believed, an instance by
the patterns it occurs in. Instances that only trusted patterns vouch for are
added to the spans.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlens.session import durable

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no input makes them recurse or go back over what they have read.
# An email starts where a run of its characters starts, or where the match before it ended.
_EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])"
          r"[A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)")
_IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
# Only runs of 14 to 19 digits can be cards; other runs are matches that fail.
_CARD = r"[0-9](?<![0-9]{2})(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters of a candidate token: anything but white space, quotes, brackets and separators.
_TOKEN = r"""[^\s"'<>(){}\[\],;|=]"""

#: Characters before and after an occurrence that its patterns are read from.
LEFT, RIGHT = 80, 40
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sums(steps: Column) -> Column:
    """Running sums of an array, by sums of blocks, so that long arrays do not cost their square."""
    add = lambda a, b: a + b
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")),
                         lambda b: total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    return let(blocks, lambda bs: F.transform(steps, lambda _, i: total(F.slice(bs, F.lit(1), F.floor(i / _BLOCK).cast("int")))
                                              + total(F.slice(steps, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1))))


_SPAN = "array<struct<start: bigint, stop: bigint, value: string, left: string, right: string>>"


def found(text: Column, pattern: str) -> Column:
    """Spans of a pattern's leftmost matches, in code points, with what stands around them."""
    def spans(hits: Column, gaps: Column) -> Column:
        steps = F.transform(hits, lambda h, i: (F.length(gaps[i]) + F.length(h)).cast("long"))
        return let(steps, lambda st: let(_sums(st), lambda stops: F.transform(hits, lambda h, i: F.struct(
            (stops[i] - F.length(h)).alias("start"), stops[i].alias("stop"), h.alias("value"),
            F.right(gaps[i], F.lit(LEFT)).alias("left"), F.left(gaps[i + 1], F.lit(RIGHT)).alias("right")))))

    p = F.lit(pattern)
    return let(F.regexp_extract_all(text, p, 0), lambda hits: F.when(F.size(hits) == 0, F.array().cast(_SPAN)).otherwise(
        let(F.split(text, pattern, -1), lambda gaps: spans(hits, gaps))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    def digit(d: Column, i: Column) -> Column:
        n = F.substring(d, i, F.lit(1)).cast("int")
        twice = n * 2
        return F.when((F.length(d) - i) % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return let(_digits(value), lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + digit(d, i)) % 10 == 0)


def base_spans(text: Column) -> Column:
    """The base kinds' spans, sorted by start and then as the kinds are listed."""
    none = F.array().cast(_SPAN)
    has_digit = text.rlike("[0-9]")
    of_kind = {
        "email": F.when(text.contains("@"), found(text, _EMAIL)).otherwise(none),
        "ip": F.filter(F.when(has_digit, found(text, _IP)).otherwise(none),
                       lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
        "card": F.filter(F.when(has_digit, found(text, _CARD)).otherwise(none), lambda s: luhn(s["value"])),
        "phone": F.filter(F.when(text.contains("+"), found(text, _PHONE)).otherwise(none),
                          lambda s: F.length(_digits(s["value"])).between(10, 15)),
    }
    def numbered(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"),
            s["left"].alias("left"), s["right"].alias("right")))

    each = [numbered(of_kind[k], n) for n, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def candidates(text: Column) -> Column:
    """Tokens that hold digits: the run from a token's first digit on, and what stands before it in the token."""
    def whole(s: Column) -> Column:
        return let(F.regexp_extract(s["left"], f"({_TOKEN}*)$", 1), lambda head: F.struct(
            (s["start"] - F.length(head)).alias("start"), s["stop"].alias("stop"), F.concat(head, s["value"]).alias("value"),
            F.left(s["left"], F.length(s["left"]) - F.length(head)).alias("left"), s["right"].alias("right")))
    spans = F.when(text.rlike("[0-9]"), found(text, rf"[0-9]{_TOKEN}*+")).otherwise(F.array().cast(_SPAN))
    # What ends a sentence is no part of an identifier.
    trimmed = F.transform(F.transform(spans, whole), lambda s: let(F.rtrim(s["value"], F.lit(".:!?*#$%&")), lambda v: F.struct(
        s["start"].alias("start"), (s["start"] + F.length(v)).alias("stop"), v.alias("value"), s["left"].alias("left"),
        s["right"].alias("right"))))
    return F.filter(trimmed, lambda s: (F.length(s["value"]) >= 6) & (F.length(_digits(s["value"])) >= 2))


def patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of an occurrence: the word before it, the two before it, the words on both sides."""
    words = r"\p{L}+|[:=#]"
    def of(before: Column, after: Column) -> Column:
        last, prior, following = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2)), F.try_element_at(after, F.lit(1))
        return F.filter(F.array(F.concat(last, F.lit(" _")), F.concat(prior, F.lit(" "), last, F.lit(" _")),
                                F.concat(last, F.lit(" _ "), following)), lambda p: p.isNotNull())
    return let(F.regexp_extract_all(F.lower(left), F.lit(words), 0), lambda b: let(
        F.regexp_extract_all(F.lower(right), F.lit(words), 0), lambda a: of(b, a)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_seeds: int = 3,
             pattern_trust: float = 0.6, instance_trust: float = 0.75, prior: float = 1.0) -> DataFrame:
    """Base and discovered spans of whole texts, one row per document: ``doc_id, text_sha, base, added``.

    ``base`` and ``added`` are sorted arrays of ``start, kind, stop, value``
    (``base`` also with what stands around), ``kind`` counting KINDS from 0;
    offsets are code points. Null texts count as empty: no spans. Repeated rows
    get equal results and count once as evidence, null ids stay null, an empty
    table gives no rows, and other columns are not read.

    A pattern's score for a kind is the sum of its distinct instances' beliefs
    over their number plus ``prior``; it counts from ``min_seeds`` distinct
    seeds and ``pattern_trust`` on. An instance that is no seed is believed as
    far as its patterns are not all wrong; from ``instance_trust`` on, its
    occurrences are added under the kind believed most. Added spans never
    overlap base ones.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # The one pass over the texts; all else works on spans.
    rows = durable(read.select("doc_id", F.sha2("text", 256).alias("text_sha"), base_spans(F.col("text")).alias("base"),
                               candidates(F.col("text")).alias("candidates")))
    added = discovered(rows, rounds, min_seeds, pattern_trust, instance_trust, prior)
    key = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha") == F.col("b.text_sha"))
    return rows.alias("a").join(added.alias("b"), key, "left").select(
        "a.doc_id", "a.text_sha", "a.base", F.coalesce("b.added", F.array().cast("array<struct<start: bigint, kind: int, stop: bigint, value: string>>")).alias("added"))


def discovered(rows: DataFrame, rounds: int, min_seeds: int, pattern_trust: float, instance_trust: float, prior: float) -> DataFrame:
    """Spans the bootstrapping adds: ``doc_id, text_sha, added``, for documents that have any."""
    some = rows.where((F.size("base") > 0) | (F.size("candidates") > 0)).dropDuplicates(["doc_id", "text_sha"])
    tagged = F.concat(
        F.transform("base", lambda s: F.struct(s["start"], s["kind"].alias("kind"), s["stop"], s["value"], s["left"], s["right"])),
        F.transform("candidates", lambda s: F.struct(s["start"], F.lit(None).cast("int").alias("kind"), s["stop"], s["value"], s["left"], s["right"])))
    spans = some.select("doc_id", "text_sha", F.inline(tagged.cast(
        "array<struct<start: bigint, kind: int, stop: bigint, value: string, left: string, right: string>>")))
    # A candidate that overlaps a base span is that span's own text.
    order = Window.partitionBy("doc_id", "text_sha").orderBy("start", "stop")
    seed = F.col("kind").isNotNull()
    spans = spans.select("*", F.max(F.when(seed, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("until"),
                         F.min(F.when(seed, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    clear = (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("stop")))
    spans = durable(spans.where(seed | clear).select("doc_id", "text_sha", "start", "kind", "stop", "value", patterns(F.col("left"), F.col("right")).alias("patterns")))

    # The graph: each pattern with each distinct instance once, however often copies repeat it.
    edges = durable(spans.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    seeds = edges.where("kind IS NOT NULL").groupBy("value", "kind").agg(F.lit(1.0).alias("belief"))
    known = seeds.select("value").distinct()
    open_edges = edges.where("kind IS NULL").select("pattern", "value").join(known, "value", "left_anti")
    supported = (edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
                 .where(F.col("seeds") >= min_seeds))
    beliefs = seeds
    for _ in range(rounds):
        scores = (edges.select("pattern", "value").join(beliefs, "value").groupBy("pattern", "kind").agg(F.sum("belief").alias("sum"))
                  .join(supported, ["pattern", "kind"]).join(sizes, "pattern")
                  .select("pattern", "kind", (F.col("sum") / (F.col("instances") + prior)).alias("score"))
                  .where(F.col("score") >= pattern_trust))
        guessed = open_edges.join(scores, "pattern").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))))).alias("belief"))
        beliefs = durable(seeds.unionByName(guessed))
    best = (beliefs.join(known, "value", "left_anti").groupBy("value")
            .agg(F.max(F.struct("belief", (-F.col("kind")).alias("order"))).alias("best"))
            .where(F.col("best.belief") >= instance_trust).select("value", (-F.col("best.order")).alias("as")))
    hits = spans.where("kind IS NULL").select("doc_id", "text_sha", "start", "stop", "value").join(best, "value")
    return hits.groupBy("doc_id", "text_sha").agg(F.array_sort(F.collect_set(F.struct(
        "start", F.col("as").cast("int").alias("kind"), "stop", "value"))).alias("added"))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def all_spans(base: Column, added: Column) -> Column:
    bare = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))
    return F.array_sort(F.concat(bare, added))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, sorted by start, replaced by its kind; spans that overlap become one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(kind_name(s["kind"])), F.lit("]"))).otherwise(F.lit(""))
        return F.when(s["stop"] <= acc["at"], acc).otherwise(F.struct(s["stop"].alias("at"), F.concat(acc["out"], kept, mark).alias("out")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))))


def without_pii(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns; personal data in ``text`` is replaced by its kind, ``n_chars`` follows."""
    spans = find_pii(docs).where((F.size("base") > 0) | (F.size("added") > 0)).select(
        F.col("doc_id").alias("of"), F.col("text_sha").alias("sha"), all_spans(F.col("base"), F.col("added")).alias("spans"))
    spans = spans.dropDuplicates(["of", "sha"])
    joined = docs.join(spans.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col("of")) & (F.sha2(docs["text"], 256) == F.col("sha")), "left")
    text = F.when(F.col("spans").isNull(), docs["text"]).otherwise(redacted(docs["text"], F.col("spans")))
    columns = [text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return joined.select(*columns)
