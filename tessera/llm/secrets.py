"""Secret scans by a trigram inverted index, in DataFrame functions alone.

Each rule's regular expression gives a Boolean trigram query. The needed trigrams of every text are its postings; they
are intersected by counting, for each text and alternative, how many of its trigrams are there. Texts that fulfil a
rule's query are candidates, and only they are verified by the regular expression. Rules without mandatory trigrams
(long hexadecimal runs) scan every text. Equal texts share postings, and a collision of hashes could only add a
candidate, which the verification then drops.

The index holds a hash of each text, not the text. The candidates' hashes go to the texts by broadcast if they are no
more than ``broadcast_keys``, so that no text moves; beyond that both sides meet in a shuffle, with the same result.

Spans are code points from the text's start, end exclusive. Matches of one rule are leftmost and do not overlap;
matches that are too short count as matched but are dropped. Offsets are prefix sums of the lengths of the matches and
of what lies between, made block by block, so that their cost is in proportion to the matches.

Defined cases: a null text is empty and has no span; repeated rows each get their spans; rows are never matched by
id; an empty table gives none; very long texts with very many spans cost no more for each span; extra columns pass
through ``scan`` whatever they are called, but for one named secrets, which the output replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, trigrams
from tessera.llm.common import Scratch


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` of which group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the same as runs of 16 or more among all runs
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
#: What follows a private key's header line: all up to the END line, or the base64 lines where END is missing.
KEY_BODY = (
    r"\A(?:\s*(?:Proc-Type|DEK-Info):[^\n]*\n){0,4}"
    r"(?:[A-Za-z0-9+/=\s\\\"',>#*|]*-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|(?:[\s\"',>#*|]*+(?:\\[nr])*+[\s\"',>#*|]*+[A-Za-z0-9+/]{16,}+={0,2}+){0,512}"
    r"(?:\s*+(?:\\[nr])*+\s*+[A-Za-z0-9+/]{1,15}={1,2})?)"
)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix(values: Column, combine, start: Column, levels: int = 2, block: int = 32) -> Column:
    """What ``combine`` makes of the values before each place of an array; ``start`` for the first place.

    Blocks are folded first and what lies before each of them comes from the level above, so a place costs half a block.
    """

    def before(own: Column, at: Column, n: Column, first: Column) -> Column:
        return F.aggregate(F.slice(own, at, n), first, combine)

    if not levels:
        return _bind(values, lambda own: F.transform(own, lambda _, i: before(own, F.lit(1), i, start)))

    def placed(own: Column) -> Column:
        heads = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
        folded = F.transform(heads, lambda h: before(own, h + 1, F.lit(block), start))
        return _bind(
            prefix(folded, combine, start, levels - 1, block),
            lambda above: F.transform(own, lambda _, i: before(own, i - i % block + 1, i % block, F.element_at(above, (i / block).cast("int") + 1))),
        )

    return _bind(values, placed)


def _parts(text: Column, rule: Rule, rank: int) -> Column:
    """Lengths of one rule's matches in one text, of what lies between them, and of what must not be too short."""
    regex = F.lit(rule.pattern)
    found = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.char_length(m))
    return F.struct(
        F.lit(rank).alias("rank"),
        F.lit(rule.kind).alias("kind"),
        F.lit(rule.least).alias("least"),
        found.alias("m"),
        F.transform(F.split(text, rule.pattern, -1), lambda g: F.char_length(g)).alias("g"),
        F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), lambda m: F.char_length(m)).alias("s"),
    )


def _spans(p: Column) -> Column:
    """Spans from the lengths that ``_parts`` gives."""
    # The gap before each match and the match itself: before a match lie all of them before it, and its gap.
    steps = F.zip_with(F.slice(p["g"], 1, F.size(p["m"])), p["m"], lambda g, m: g + m)
    ends = _bind(steps, lambda own: F.zip_with(prefix(own, lambda a, x: a + x, F.lit(0)), own, lambda a, x: a + x))
    placed = F.zip_with(F.zip_with(ends, p["m"], lambda e, m: F.struct((e - m).alias("start"), e.alias("end"))), p["s"], lambda x, own: F.when(own >= p["least"], x))
    return F.transform(
        F.array_compact(placed),
        lambda x: F.struct(x["start"].alias("start"), p["rank"].alias("rank"), p["kind"].alias("kind"), x["end"].alias("end")),
    )


def postings(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, key): each wanted trigram with the keys of the texts that hold it; the index."""
    lowered = texts.select("__key", F.lower("__text").alias("__low"))
    held = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("__low"), t))
    return lowered.select("__key", F.explode(held).alias("trigram"))


def candidates(texts: DataFrame, queries: dict[str, trigrams.Query]) -> DataFrame:
    """(__key, __rules): the rules whose query the text's postings fulfil, as a bit for each in the order of ``queries``."""
    spark = texts.sparkSession
    clauses = [(place, alt) for place, q in enumerate(queries.values()) for alt in q]
    terms = [(c, 1 << b, t) for c, (_, alt) in enumerate(clauses) for b, t in enumerate(sorted(alt))]
    table = spark.createDataFrame(terms, "clause int, bit long, trigram string")  # as many as the rules need
    whole = F.array(*[F.lit((1 << len(alt)) - 1).cast("long") for _, alt in clauses])
    rule = F.array(*[F.lit(1 << place).cast("long") for place, _ in clauses])
    held = (
        postings(texts, sorted({t[2] for t in terms}))
        .join(F.broadcast(table), "trigram")
        .groupBy("__key", "clause")
        .agg(F.bit_or("bit").alias("held"))  # equal texts fall together before they are dealt
        .where(F.col("held") == F.element_at(whole, F.col("clause") + 1))
    )
    return held.groupBy("__key").agg(F.bit_or(F.element_at(rule, F.col("clause") + 1)).alias("__rules"))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_keys: int = 1_000_000) -> DataFrame:
    """``documents`` with secrets: spans (start, rank, kind, end) by start, then in the order of the rules."""
    base = documents.drop("secrets")
    key, asked_of = common.fresh(base, "__key", "__rules")
    text = F.coalesce(F.col("text"), F.lit(""))
    queries = {r.kind: trigrams.query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    rows, bits = base, F.lit(0).cast("long")
    if indexed:
        hashed = F.xxhash64(text)
        found = Scratch(base.sparkSession, "secrets").write(
            candidates(base.select(hashed.alias("__key"), text.alias("__text")), indexed)
        )
        few = found.count() <= broadcast_keys
        # Written first, so that a join beyond the bound deals both sides itself and can split the rows of a very common text.
        side = found.toDF(key, asked_of)
        rows = base.withColumn(key, hashed).join(F.broadcast(side) if few else side.hint("shuffle_hash"), key, "left")
        bits = F.coalesce(F.col(asked_of), F.lit(0).cast("long"))
    each = []
    for rank, rule in enumerate(rules):
        asked = bits.bitwiseAND(F.lit(1 << list(indexed).index(rule.kind))) != 0 if rule.kind in indexed else F.lit(True)
        # Few candidates match: the offsets are worked out for those alone.
        each.append(F.when(asked & text.rlike(rule.pattern), _parts(text, rule, rank)))
    spans = F.flatten(F.transform(F.array_compact(F.array(*each)), _spans)).cast(SPAN)
    return rows.withColumn("secrets", F.array_sort(spans)).drop(key, asked_of)


def redact(scanned: DataFrame, chunk: int = 4096) -> DataFrame:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one.

    A private key goes with its body, though its span is the header line alone. The text is cut into chunks once, and
    what stays between spans is taken from those, so a text with very many spans is not read again for each.
    """
    text, rest = F.col("text"), F.lit(2**31 - 1)

    def end_of(s: Column) -> Column:
        body = F.regexp_extract(F.substring(text, s["end"] + 1, rest), KEY_BODY, 0)
        return s["end"] + F.when(s["kind"] == "private_key", F.char_length(body)).otherwise(0)

    def between(chunks: Column, a: Column, b: Column) -> Column:
        first = (a / chunk).cast("int")
        part = F.array_join(F.slice(chunks, first + 1, (b / chunk).cast("int") - first + 1), "")
        return F.substring(part, a - first * chunk + 1, b - a)

    def cleaned(x: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.element_at(x["taken"], i + 1)
            return F.when(s["start"] >= at, F.concat(between(x["chunks"], at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

        last = F.greatest(F.element_at(x["taken"], -1), F.element_at(x["ends"], -1))
        return F.concat(F.array_join(F.transform(F.col("secrets"), piece), ""), between(x["chunks"], last, F.char_length(text)))

    ends = F.transform("secrets", end_of)
    parts = _bind(
        ends,
        lambda e: F.struct(
            e.alias("ends"),
            prefix(e, lambda a, x: F.greatest(a, x), F.lit(0)).alias("taken"),
            F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("chunks"),
        ),
    )
    return scanned.withColumn("text", F.when(F.size("secrets") > 0, _bind(parts, cleaned)).otherwise(text))


def as_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(documents).select("doc_id", "secrets")

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[of(r.kind) for r in BASE],
        F.sha2(as_text(base), 256).alias("base_sha256"),
        as_text(F.col("secrets")).alias("spans"),
    )


def op9_sql() -> str:
    """The same spans by DuckDB: offsets from the lengths of matches and of what lies between."""

    def lit(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    parts = []
    for rank, r in enumerate(RULES):
        p = lit(r.pattern)
        parts.append(f"""SELECT id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least,
               list_transform(regexp_extract_all(t, {p}), lambda x: length(x)) AS m,
               list_transform(string_split_regex(t, {p}), lambda x: length(x)) AS g,
               list_transform(regexp_extract_all(t, {p}, {r.group}), lambda x: length(x)) AS s
        FROM d WHERE regexp_matches(t, {p})""")
    rules = "\n        UNION ALL\n        ".join(parts)
    base = len(BASE)
    counts = ", ".join(f"count(kind) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
    WITH d AS (
        SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
    ), found AS (
        {rules}
    ), numbered AS (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found
    ), spans AS (
        SELECT id, rank, kind, (list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))::BIGINT AS a, m[i] AS size FROM numbered WHERE s[i] >= least
    )
    SELECT doc_id, {counts},
           sha256(coalesce(string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rank) FILTER (rank < {base}), '')) AS base_sha256,
           coalesce(string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, rank), '') AS spans
    FROM d LEFT JOIN spans USING (id) GROUP BY id, doc_id
    """
