"""The engine's queries by name, each over whole tables, and the SQL that must give the same rows.

A query that searches does so on codes; the SQL does the same on the values.
"""
from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.api import Codec
from stringloom.config import Config
from stringloom.functions.dictionary import Dictionary, TokenRange
from stringloom.operators import frequency, predicates
from stringloom.operators.codec import decode, encode, unpack
from stringloom.operators.train import learn
from stringloom.plans.cover import Cover
from stringloom.sources import interchange
from stringloom.sources.tables import spread, string_column, table, urls

#: Words of the dictionary that the fixed-dictionary queries use, beside the single bytes.
FIXED = ("http", "https", "://", "example", ".com", ".org", "www.", "blog.", "/en/", "/de/", "red", "green", "blue", "an", "in")
LONG = " ".join(["the"] * 90)


@cache
def codec(spark: SparkSession, sf_dir: str, name: str, column: str, bits: int = 12) -> Codec:
    """Fitted once for a table and column."""
    return Codec.fit(table(spark, sf_dir, name), column, Config(max_dict_bits=bits))


def _encoded(spark, sf_dir, name, key, column, bits=12, codes=True):
    """The fitted codec and the encoded table, without the values; codes False: packed rows alone."""
    made = codec(spark, sf_dir, name, column, bits)
    return made, made.transform(spread(table(spark, sf_dir, name).select(key, column)), drop=True, codes=codes)


def _round_trip(name, key, column, bits=12):
    def query(spark, sf_dir):
        made, rows = _encoded(spark, sf_dir, name, key, column, bits, codes=False)
        return made.decode(rows, "value").select(key, "value")

    return query, f"SELECT {key}, {column} AS value FROM {name}"


def _search(method, name, key, column, needle, bits=12):
    test = {"equal_to": "{c} = '{n}'", "starting_with": "starts_with({c}, '{n}')", "containing": "contains({c}, '{n}')", "containing_with_scan": "contains({c}, '{n}')"}[method]

    def query(spark, sf_dir):
        made, rows = _encoded(spark, sf_dir, name, key, column, bits, codes=False)
        return getattr(made, method)(rows, needle).select(key)

    return query, f"SELECT {key} FROM {name} WHERE " + test.format(c=column, n=needle.replace("'", "''"))


def _planned_scan(spark, sf_dir):
    made, rows = _encoded(spark, sf_dir, "documents", "doc_id", "text")
    index = made.sampled_frequencies(rows, 0.05)
    return made.containing_with_scan(rows, "thing the", index).select("doc_id")


def _random_access(spark, sf_dir):
    made, rows = _encoded(spark, sf_dir, "documents", "doc_id", "text", codes=False)
    return made.decode_row(rows, "doc_id", 7).select("doc_id", "value")


def _byte_histogram(spark, sf_dir):
    rows = encode(table(spark, sf_dir, "part").select("p_name"), "p_name", Dictionary.of())
    return frequency.counts(rows, Dictionary.of()).where("cnt > 0").select(F.char("code").alias("ch"), "cnt")


def _fixed_counts(name, column):
    """Occurrences of each token under a fixed dictionary; longest first is what greedy matching gives."""
    pattern = "|".join(sorted((t.replace(".", r"\.") for t in FIXED), key=lambda t: -len(t.replace("\\", ""))))

    def query(spark, sf_dir):
        fixed = Dictionary.of(t.encode() for t in FIXED)
        rows = encode(table(spark, sf_dir, name).select(column), column, fixed)
        words = fixed.to_dataframe(spark).select("code", F.col("token").cast("string").alias("token"))
        return frequency.counts(rows, fixed).where("cnt > 0").join(F.broadcast(words), "code").select("token", "cnt")

    sql = f"SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all({column}, '(?s:{pattern}|.)')) AS token FROM {name}) GROUP BY token"
    return query, sql


def _cumulative(spark, sf_dir):
    rows = encode(table(spark, sf_dir, "part").select("p_name"), "p_name", Dictionary.of())
    return frequency.counts(rows, Dictionary.of()).where("cnt > 0").select("code", "cnt", "cumulative")


def _range_frequency(spark, sf_dir):
    rows = encode(table(spark, sf_dir, "part").select("p_name"), "p_name", Dictionary.of())
    index = frequency.build(rows, Dictionary.of())
    vowels = [("a", "e"), ("f", "m"), ("n", "z")]
    return spark.createDataFrame([(a, b, index.range_frequency(TokenRange(ord(a), ord(b)))) for a, b in vowels], "lo string, hi string, n long")


def _decoded_length(spark, sf_dir):
    """Languages travel with the rows, so ids may be missing or repeated."""
    made = codec(spark, sf_dir, "documents", "text")
    rows = made.transform(spread(table(spark, sf_dir, "documents").select("lang", "text")), drop=True, codes=False)
    return made.decode(rows, "value", "binary").groupBy("lang").agg(F.sum(F.octet_length("value")).cast("long").alias("n_bytes"))


def _range_decode(spark, sf_dir):
    """Any slice of a row's codes decodes on its own: the pieces put together are the value."""
    made, rows = _encoded(spark, sf_dir, "pages", "page_id", "url")
    half = F.floor(F.size("codes") / 2).cast("int")
    parts = rows.select("page_id", F.slice("codes", F.lit(1), half).alias("a"), F.slice("codes", half + 1, F.size("codes")).alias("b"))
    back = decode(decode(parts, made.dictionary, "a", "x", "string"), made.dictionary, "b", "y", "string")
    return back.select("page_id", F.concat("x", "y").alias("value"))


def _packed(spark, sf_dir):
    made, rows = _encoded(spark, sf_dir, "pages", "page_id", "url")
    again = rows.select("page_id", unpack(F.col("packed")).alias("codes"))
    return decode(again, made.dictionary, kind="string").select("page_id", "value")


def _interchange(spark, sf_dir):
    made, rows = _encoded(spark, sf_dir, "pages", "page_id", "url")
    chunks = interchange.export(rows, made.dictionary, ["page_id"])
    return interchange.load(chunks, ["page_id"]).select("page_id", F.col("value").cast("string").alias("value"))


def _dedup_first(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "props")
    made = codec(spark, sf_dir, "events", "props")
    return made.decode(made.transform_distinct(df)).select("event_id", "value")


def _generic_source(spark, sf_dir):
    """The first string column of a table, NULL as empty."""
    df = string_column(table(spark, sf_dir, "part"))
    made = Codec.fit(df, "v", Config(max_dict_bits=10))
    return made.decode(made.transform(df)).groupBy("value").agg(F.count("*").alias("n"))


def _conformance(spark, sf_dir):
    out = []
    for bits in range(9, 17):
        made = codec(spark, sf_dir, "pages", "url", bits).dictionary
        out.append((bits, made.sorted, made.complete, made.num_tokens <= 1 << bits, made.code_bits <= bits, max(map(len, made.tokens)) <= 16))
    return spark.createDataFrame(out, "bits int, sorted boolean, complete boolean, fits boolean, narrow boolean, short boolean")


def _empty_training(spark, sf_dir):
    empty = learn([], Config())
    return spark.createDataFrame([(empty.num_tokens, empty.code_bits, empty.logical_len)], "num_tokens int, code_bits int, logical_len int")


def _expected_hits(spark, sf_dir):
    """The index's count of a plan's cover against a count over all codes, as the difference."""
    made, rows = _encoded(spark, sf_dir, "documents", "doc_id", "text")
    index = made.frequencies(rows)
    out = None
    for pattern in ("thing", "e", "ciónes", "schaft und"):
        plan = made.plan(pattern, index)
        brute = rows.select(F.explode("codes").alias("c")).where(_in(F.col("c"), plan.cover)).agg((F.count("*") - plan.expected_hits(index.cumulative)).alias("difference"))
        part = brute.select(F.lit(pattern).alias("pattern"), "difference")
        out = part if out is None else out.unionByName(part)
    return out


def _in(c, cover: Cover):
    test = F.lit(False)
    for a, b in cover.ranges:
        test = test | c.between(a, b)
    return test | c.isin(cover.points) if cover.points else test


def _prefix_range(spark, sf_dir):
    fixed = Dictionary.of(t.encode() for t in FIXED)
    rows = [(p, len(fixed.prefix_range(p.encode()))) for p in ("http", "e", "w", "/", "", "nothing here")]
    return spark.createDataFrame(rows, "prefix string, n int")


def _prefix_range_sql():
    tokens = ", ".join(f"'{t}'" for t in FIXED)
    every = f"SELECT unnest([{tokens}]) AS t UNION ALL SELECT chr(i::INT) FROM range(1, 128) r(i)"
    # bytes that aren't characters of their own (0 and 128 to 255) only start with the empty prefix
    return f"SELECT p AS prefix, ((SELECT count(*) FROM ({every}) WHERE starts_with(t, p)) + CASE WHEN p = '' THEN 129 ELSE 0 END)::INT AS n FROM (SELECT unnest(['http', 'e', 'w', '/', '', 'nothing here']) AS p)"


def _compression(spark, sf_dir):
    out = None
    for name, key, column in (("documents", "doc_id", "text"), ("pages", "page_id", "url"), ("pages", "page_id", "html")):
        made = codec(spark, sf_dir, name, column)
        part = made.compression(made.transform(table(spark, sf_dir, name).select(key, column))).select(F.lit(f"{name}.{column}").alias("column"), "raw_bytes", "n_codes", "n_rows", "stored_bytes", "ratio")
        out = part if out is None else out.unionByName(part)
    return out


def _token_table(spark, sf_dir):
    return codec(spark, sf_dir, "documents", "text").dictionary.to_dataframe(spark)


def _urls(spark, sf_dir):
    return urls(spark, 100_000)


def _url_hosts(spark, sf_dir):
    """The generator's hosts and sections: with so many URLs, each pair occurs."""
    parts = F.regexp_extract("url", r"^https://([^/]+)/([^?]+)\?id=[0-9]+$", 1), F.regexp_extract("url", r"^https://([^/]+)/([^?]+)\?id=[0-9]+$", 2)
    return urls(spark, 100_000).select(parts[0].alias("host"), parts[1].alias("section")).distinct()


_HOSTS_SQL = """
SELECT sub || '.' || name || '.example' AS host, section
FROM (SELECT unnest(['www', 'm', 'shop']) AS sub), (SELECT unnest(['news', 'maps', 'video']) AS name),
     (SELECT unnest(['search', 'item', 'user/profile', 'cart', 'article/2024', 'tag', 'static/img']) AS section)
"""


def _byte_tokens(spark, sf_dir):
    """The tokens of one byte of a trained dictionary, and how many longer ones start with each byte's token range, which holds its own."""
    made = codec(spark, sf_dir, "documents", "text").dictionary
    tokens = made.to_dataframe(spark).where(F.octet_length("token") == 1)
    rows = [(i, len(made.prefix_range(bytes([i]))) >= 1) for i in range(256)]
    return tokens.select(F.hex("token").alias("byte")).join(spark.createDataFrame(rows, "b int, held boolean").select(F.lpad(F.hex("b"), 2, "0").alias("byte"), "held"), "byte")


def _sizes(spark, sf_dir):
    """What compression() counts of the values themselves, and whether their codes are smaller."""
    return _compression(spark, sf_dir).select("column", "raw_bytes", "n_rows", (2 * F.col("n_codes") < F.col("raw_bytes")).alias("smaller"))


_SIZES_SQL = " UNION ALL ".join(
    f"SELECT '{t}.{c}' AS column, sum(octet_length(encode({c})))::BIGINT AS raw_bytes, count(*) AS n_rows, true AS smaller FROM {t}" for t, c in (("documents", "text"), ("pages", "url"), ("pages", "html"))
)


def _all() -> dict:
    """name -> (query, SQL or None)."""
    return {
        "round_trip_documents": _round_trip("documents", "doc_id", "text"),
        "round_trip_documents_16": _round_trip("documents", "doc_id", "text", 16),
        "round_trip_html": _round_trip("pages", "page_id", "html"),
        "round_trip_url": _round_trip("pages", "page_id", "url", 9),
        "round_trip_part": _round_trip("part", "p_partkey", "p_name"),
        "round_trip_props": _round_trip("events", "event_id", "props"),
        "equal_part": _search("equal_to", "part", "p_partkey", "p_name", "red widget"),
        "equal_type": _search("equal_to", "orders", "o_orderkey", "o_orderpriority", "1-URGENT"),
        "equal_empty": _search("equal_to", "part", "p_partkey", "p_name", ""),
        "prefix_url": _search("starting_with", "pages", "page_id", "url", "http://m."),
        "prefix_document": _search("starting_with", "documents", "doc_id", "text", "The "),
        "prefix_absent": _search("starting_with", "pages", "page_id", "url", "gopher://nowhere"),
        "prefix_empty": _search("starting_with", "part", "p_partkey", "p_name", ""),
        "contains_document": _search("containing", "documents", "doc_id", "text", "thing"),
        "contains_byte": _search("containing", "documents", "doc_id", "text", "z"),
        "contains_multibyte": _search("containing", "documents", "doc_id", "text", "ciónes"),
        "contains_html": _search("containing", "pages", "page_id", "html", "<p>The"),
        "contains_empty": _search("containing", "part", "p_partkey", "p_name", ""),
        "contains_16_bits": _search("containing", "documents", "doc_id", "text", "onwhen", 16),
        "scan_document": _search("containing_with_scan", "documents", "doc_id", "text", "thing"),
        "scan_two_words": _search("containing_with_scan", "documents", "doc_id", "text", "of the"),
        "scan_multibyte": _search("containing_with_scan", "documents", "doc_id", "text", "é"),
        "scan_html": _search("containing_with_scan", "pages", "page_id", "html", "<script"),
        "scan_absent": _search("containing_with_scan", "documents", "doc_id", "text", "QQzzQQ"),
        "scan_long": _search("containing_with_scan", "documents", "doc_id", "text", LONG),
        "scan_16_bits": _search("containing_with_scan", "documents", "doc_id", "text", "onwhen", 16),
        "scan_planned_by_sample": (_planned_scan, "SELECT doc_id FROM documents WHERE contains(text, 'thing the')"),
        "random_access": (_random_access, "SELECT doc_id, text AS value FROM documents WHERE doc_id = 7"),
        "range_decode": (_range_decode, "SELECT page_id, url AS value FROM pages"),
        "packed_codes": (_packed, "SELECT page_id, url AS value FROM pages"),
        "decoded_length": (_decoded_length, "SELECT lang, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY lang"),
        "byte_histogram": (_byte_histogram, "SELECT ch, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY ch"),
        "cumulative_frequency": (
            _cumulative,
            "SELECT code, cnt, (sum(cnt) OVER (ORDER BY code) - cnt)::BIGINT AS cumulative FROM (SELECT ascii(ch)::INT AS code, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY 1)",
        ),
        "range_frequency": (
            _range_frequency,
            "SELECT lo, hi, (SELECT count(*) FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch BETWEEN lo AND hi) AS n FROM (VALUES ('a', 'e'), ('f', 'm'), ('n', 'z')) t(lo, hi)",
        ),
        "fixed_tokens_url": _fixed_counts("pages", "url"),
        "fixed_tokens_part": _fixed_counts("part", "p_name"),
        "interchange": (_interchange, "SELECT page_id, url AS value FROM pages"),
        "dedup_first": (_dedup_first, "SELECT event_id, props AS value FROM events"),
        "generic_source": (_generic_source, "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name"),
        "conformance": (_conformance, "SELECT b::INT AS bits, true AS sorted, true AS complete, true AS fits, true AS narrow, true AS short FROM range(9, 17) r(b)"),
        "empty_training": (_empty_training, "SELECT 256::INT AS num_tokens, 8::INT AS code_bits, 256::INT AS logical_len"),
        "expected_hits": (_expected_hits, "SELECT p AS pattern, 0::BIGINT AS difference FROM (SELECT unnest(['thing', 'e', 'ciónes', 'schaft und']) AS p)"),
        "prefix_range": (_prefix_range, _prefix_range_sql()),
        "compression": (_compression, None),
        "token_table": (_token_table, None),
        "synthetic_urls": (_urls, None),
        "compression_sizes": (_sizes, _SIZES_SQL),
        "byte_tokens": (_byte_tokens, "SELECT printf('%02X', b::INT) AS byte, true AS held FROM range(256) r(b)"),
        "synthetic_url_hosts": (_url_hosts, _HOSTS_SQL),
    }


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def entry(spark: SparkSession) -> DataFrame:
    """Substring search on the codes of documents, at the smallest scale."""
    return _all()["contains_document"][0](spark, "/root/testdata/sf0.001")
