"""Operator 1: personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base: emails, IP addresses, card numbers and phone numbers by patterns; a hit that fails its test is dropped. They are the seeds, together
with long hexadecimal tokens (SECRET), which are seeds alone: they count as found only where the contexts say so.
The words that stand beside a seed are its lexical patterns (one word or two before it, one or two after it, one on each side; by kind).
Candidates are the tokens with a digit or "@" that no base span touches. Patterns and instances form a graph that is scored for at most
ROUNDS rounds, or until the accepted instances stay the same: a pattern scores by the share of its distinct instances (one more) that are
known (seeds, and what was accepted in earlier rounds), an instance by its patterns; an instance is accepted if its confident patterns'
scores sum to ACCEPT, or if one of them has at least STRONG. Every occurrence of an accepted instance becomes a span `other`, so
identifiers of unseen form are found where they stand in the places of known ones. Base spans always stay.

Texts are read once: hits and candidates, with their places and contexts, are a table in the shared folder; all rounds work on that.
Places come from splitting by the same pattern (lengths of what lies between, in code points). Patterns are written without
backtracking (possessive, with bounded nesting), so long runs cost linear time and no deep stack. A context is looked for within CONTEXT
code points of the span; a word that this cuts is left out.

Defined results: null or empty text has no spans (empty strings; base_sha256 of the empty string); rows with the same doc_id are judged
each by their own text; a very long text is judged as a whole; an empty table gives no rows; other columns are ignored, and kept as they
are by `redact`, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A match starts where a run starts, or where the last match ended: leftmost matches of the plain patterns start nowhere else.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?>(?:\.{_DOMAIN}++){{1,500}})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # fewer than 14 digits never pass, so such runs are passed over here
    "card": r"[0-9](?:[\x20-]?[0-9]){13}(?>(?:[\x20-]?[0-9]){1,500})*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Tokens that are seeds of the kind `secret`.
SECRET = "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
ROUNDS, CONFIDENT, SUPPORT, ACCEPT, STRONG, CONTEXT = 3, 0.6, 3, 1.2, 0.9, 160
#: Occurrences of accepted instances up to which they are sent to every worker; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
_OPENING, _CLOSING = "\"'([{<", ".,;:!?)\"'\\]}>"

_NONE = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
#: Matches of a block, in `_found`.
BLOCK = 128


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before, after>> of all matches, places in code points; before, after: the text up to the next matches.

    A running sum by way of an array that grows costs the square of its length, so it runs within blocks of matches and over blocks.
    """
    match, piece = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    between = F.greatest(F.size(piece) - 1, F.lit(0))
    both = F.arrays_zip(match.alias("m"), F.slice(piece, F.lit(1), between).alias("p"), F.slice(piece, F.lit(2), between).alias("q"))
    blocks = F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(both) / BLOCK).cast("int")), lambda b: b * BLOCK < F.size(both)), lambda b: F.slice(both, b * BLOCK + 1, F.lit(BLOCK)))

    def next_block(acc, block):
        length = F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["p"]) + F.length(x["m"]))
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), block.alias("block")))).alias("out"))

    placed = F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,block:array<struct<m:string,p:string,q:string>>>>").alias("out")), next_block, lambda acc: acc["out"]
    )

    def next_match(acc, x):
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        before = F.when(F.length(x["p"]) > CONTEXT, F.regexp_replace(F.substring(x["p"], -CONTEXT, CONTEXT), r"^\S*+", "")).otherwise(x["p"])
        after = F.when(F.length(x["q"]) > CONTEXT, F.regexp_replace(F.substring(x["q"], 1, CONTEXT), r"(?<!\S)\S++$", "")).otherwise(x["q"])
        hit = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("match"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    def of_block(block):
        return F.aggregate(block["block"], F.struct(block["at"].alias("at"), F.array().cast(_NONE).alias("out")), next_match, lambda acc: acc["out"])

    return F.flatten(F.transform(placed, of_block))


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _luhn(col: Column) -> Column:
    d = F.split(F.reverse(_digits(col)), "")
    value = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, col: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(col, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255"))
    n = F.length(_digits(col))
    if kind == "card":
        return n.between(14, 19) & _luhn(F.when(n.between(14, 19), col).otherwise(F.lit("1")))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)




def _tested(order: int, kind: str) -> Column:
    def named(x):
        return F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))

    return F.transform(F.filter(f"_{kind}", lambda x: _passes(kind, x["match"])), named)


def _counted(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _hits (struct of start, order, end, kind, match, before, after; base spans in order) and _cands (the candidates, of that form)."""
    t = F.coalesce(F.col(text), F.lit(""))
    for kind in KINDS:
        there = t.rlike(PATTERNS[kind])
        if NEEDED[kind]:
            there = F.contains(t, F.lit(NEEDED[kind])) & there
        docs = docs.withColumn(f"_{kind}", F.when(there, _found(t, PATTERNS[kind])).otherwise(F.array().cast(_NONE)))
    hits = [_tested(i, kind) for i, kind in enumerate(KINDS)]
    docs = docs.withColumn("_hits", F.array_sort(F.concat(*hits))).drop(*(f"_{k}" for k in KINDS))
    docs = docs.withColumn("_cands", F.when(t.rlike("[0-9@]"), _found(t, CANDIDATE)).otherwise(F.array().cast(_NONE)))

    def trimmed(x):
        """The token without the marks around it."""
        left = F.ltrim(x["match"], F.lit(_OPENING))
        core = F.rtrim(left, F.lit(_CLOSING))
        start = x["start"] + F.length(x["match"]) - F.length(left)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("match"), x["before"].alias("before"), x["after"].alias("after"))

    clear = F.filter(F.transform("_cands", trimmed), lambda c: (F.length(c["match"]) >= 4) & ~F.exists("_hits", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return docs.withColumn("_cands", clear)


def _patterns(before: Column, after: Column) -> Column:
    """The word, and the two words, right before and right after, and one on each side; none where white space or text is missing."""

    def words(text):
        return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    left = F.when(before.rlike(r"\s[\"'(\[{<]*+$"), words(F.regexp_replace(before, r"[\"'(\[{<]++$", ""))).otherwise(F.array().cast("array<string>"))
    right = F.when(after.rlike(r"^[.,;:!?)\"'\]}>]*+\s"), words(F.regexp_replace(after, r"^[.,;:!?)\"'\]}>]++", ""))).otherwise(F.array().cast("array<string>"))
    l1, l2, r1, r2 = F.get(left, F.size(left) - 1), F.get(left, F.size(left) - 2), F.get(right, F.lit(0)), F.get(right, F.lit(1))
    every = (("1", l1, None), ("2", l2, l1), ("+1", r1, None), ("+2", r1, r2), ("1+1", l1, r1))
    return F.array_compact(F.array(*[F.concat(F.lit(n + " "), a) if b is None else F.concat(F.lit(n + " "), a, F.lit(" "), b) for n, a, b in every]))


def bootstrap(table: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) that the seeds' contexts lead to; table: what extract() gave."""
    of = lambda x: _patterns(F.col(f"{x}.before"), F.col(f"{x}.after"))
    seeds = table.select(F.explode("_hits").alias("h")).select(F.col("h.kind").alias("kind"), F.col("h.match").alias("instance"), F.explode(of("h")).alias("pattern"))
    cands = table.select(F.explode("_cands").alias("c")).select(F.col("c.match").alias("instance"), F.explode(of("c")).alias("pattern")).distinct()
    cands = common.stage(cands, "candidates")
    secrets = cands.where(F.col("instance").rlike(SECRET)).select(F.lit("secret").alias("kind"), "instance", "pattern")
    known = common.stage(seeds.unionByName(secrets).distinct(), "seeds")
    # instances per pattern, whatever their kind
    every = common.stage(known.select("instance", "pattern").unionByName(cands).distinct().groupBy("pattern").agg(F.count("*").alias("n")), "patterns")
    first, accepted, before = known, None, None
    for _ in range(rounds):
        support = known.groupBy("kind", "pattern").agg(F.count("*").alias("f")).where(F.col("f") >= SUPPORT)
        good = support.join(every, "pattern").withColumn("score", F.col("f") / (F.col("n") + 1)).where(F.col("score") >= CONFIDENT).select("kind", "pattern", "score")
        scored = cands.join(good, "pattern").groupBy("instance", "kind").agg(F.sum("score").alias("score"), F.max("score").alias("best"))
        scored = scored.where((F.col("score") >= ACCEPT) | (F.col("best") >= STRONG))
        best = scored.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")
        accepted = common.stage(best, "accepted")
        now = accepted.agg(F.count("*"), F.sum(F.xxhash64("instance", "kind").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            return accepted
        before = now
        known = common.stage(first.unionByName(cands.join(accepted, "instance").select("kind", "instance", "pattern")).distinct(), "known")
    return accepted


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _spanned(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others, none named like those here) with _base and _spans (arrays of start, order, end, kind)."""
    names = docs.columns
    table = common.stage(extract(docs.withColumn("_key", F.xxhash64("text"))), "hits")
    accepted = bootstrap(table)
    span = "struct<start:int,order:int,end:int,kind:string>"
    base = F.transform("_hits", lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))
    where_ = table.select("doc_id", "_key", F.explode("_cands").alias("c")).select("doc_id", "_key", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.match").alias("instance"))
    more = where_.join(accepted.select("instance"), "instance").select("doc_id", "_key", F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit("other").alias("kind")).alias("s")).distinct()
    more = more.groupBy("doc_id", "_key").agg(F.collect_list("s").alias("_more"))  # of one text at most
    more = common.stage(more.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_more"), "more")
    more = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more
    out = table.select(*names, "_key", base.alias("_base")).join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    spans = F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast(f"array<{span}>"))))
    return out.select(*names, "_base", spans.alias("_spans"))


def find(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text): doc_id, base and spans (arrays of start, order, end, kind)."""
    return _spanned(docs.select("doc_id", "text")).select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    more = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *map(_counted, KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), _counted("other", "spans"), more)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(common.documents(spark, sf_dir)))


def redact(docs: DataFrame) -> DataFrame:
    """docs, with all columns, with each span of the text replaced by its kind in angle brackets (n_chars follows); overlapping spans: the first.

    The texts are written once beside their hits and not shuffled.
    """
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{n}`") for n in names if n != "text"]).alias("rest"))
    out = _spanned(packed)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        part = F.array(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], part).alias("out")))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col("text"), acc["at"] + 1)))
    hit = F.size("_spans") > 0
    out = out.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    chars = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars")) if "n_chars" in names else None
    return out.select(*[F.col("text") if n == "text" else chars.alias(n) if n == "n_chars" else F.col(f"rest.`{n}`").alias(n) for n in names])
