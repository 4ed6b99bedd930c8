"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import confusables, languages, leaks, packing, rankings, terms
from siftwell.session import cut_lineage

#: The tokenizer's file of BPE ranks, which every executor has at this path.
VOCABULARY = os.environ.get("SIFTWELL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CAPACITY = 2048
BEST = 10
#: Share of the containers' space that is used at least, and of documents in one language whose label agrees.
LEAST_FILL, LEAST_AGREED = 0.9, 0.9


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.valid_postings(*(_table(spark, sf_dir, t) for t in ("postings", "token_index", "doc_info")))


def _distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.distinctiveness(cut_lineage(_postings(spark, sf_dir)), _table(spark, sf_dir, "feedback_docs").select("doc_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.most_distinctive(_distinctive(spark, sf_dir)).select(F.col("record").alias("doc_id"), F.col("term").alias("token"))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _distinctive(spark, sf_dir)
    return s.select(F.col("record").alias("doc_id"), F.col("term").alias("token"), "tf", "df", "cf", F.round("ridf", 6).alias("ridf"), F.round("residual", 6).alias("residual"), F.round("score", 6).alias("score"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.valid_rows(*(_table(spark, sf_dir, t) for t in ("postings", "token_index", "doc_info")))


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return terms.term_frequencies(terms.term_containers(rows), terms.record_count(rows)).withColumnRenamed("term", "token")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).where("mark <> 'useful'").select("token", "mark")


def p4_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir)


def p4_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = terms.term_containers(_rows(spark, sf_dir))
    numbers = F.concat(F.coalesce(F.col("offsets").cast("array<int>"), F.array()), F.flatten(F.coalesce(F.transform("runs", lambda r: F.sequence(r["first"].cast("int"), r["last"].cast("int"))), F.array())))
    size = F.coalesce(2 * F.size("offsets"), 4 * F.size("runs"), 8 * F.size("words"))
    checksum = F.when(F.col("words").isNull(), F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("checksum")
    return held.select(F.col("term").alias("token"), "container", "kind", size.cast("bigint").alias("bytes"), "records", "occurrences", checksum)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = confusables.look_alike_pairs(_table(spark, sf_dir, "tokenizer_lines"), "line_id", "text")
    return pairs.select(F.col("a").alias("line_a"), F.col("b").alias("line_b"))


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.unify(_table(spark, sf_dir, "tokenizer_lines"), ["line_id"], "text").select("line_id", "canonical")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a look-alike, their class and number of links, without the pairs."""
    return confusables.look_alike_links(_table(spark, sf_dir, "tokenizer_lines"), "line_id", "text")


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("passage", "text")).where(F.length("text") > 0)
    return confusables.unify(lines, ["doc_id", "passage"], "text").select("doc_id", "passage", "canonical")


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring_index("name", "/", -1)
    ranks = _table(spark, sf_dir, "pageranks").groupBy(F.col("name").alias("title")).agg(F.max("rank").alias("pagerank"))
    names = _table(spark, sf_dir, "doc_info").select("doc_id", title.alias("title")).dropna().distinct()
    of_doc = names.join(ranks, "title").groupBy("doc_id").agg(F.max("pagerank").alias("pagerank"))
    runs = _table(spark, sf_dir, "run_scores").join(of_doc, "doc_id", "left")
    ranked = rankings.aggregate_rankings(runs, "query_id", "doc_id", ["tfidf", "hub", "authority", "pagerank"])
    return ranked


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rankings.best_of_each(_ranking(spark, sf_dir), BEST).select(F.col("group").alias("query_id"), F.col("item").alias("doc_id"))


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranking(spark, sf_dir)
    return r.select(F.col("group").alias("query_id"), F.col("item").alias("doc_id"), F.round("rho", 9).alias("rho"), F.round("mean_place", 9).alias("mean_place"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return packing.pack(_table(spark, sf_dir, "documents"), CAPACITY, VOCABULARY, PATTERN)


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p7_containers, one row: every document is there once, piece by piece without a gap; containers above the
    capacity and documents cut without need, of which there are none; and whether LEAST_FILL of the containers' space is used."""
    held = cut_lineage(p7_containers(spark, sf_dir))
    docs = held.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("places"), F.max(F.col("start") + F.col("tokens")).alias("end"))
    whole = F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~whole).alias("cut"), F.count_if((F.col("pieces") != F.col("places")) | (F.col("n") != F.col("end"))).alias("torn"))
    full = held.groupBy("container").agg(F.sum("tokens").alias("n"))
    full = full.agg(F.count_if(F.col("n") > CAPACITY).alias("over"), (F.sum("n") >= LEAST_FILL * CAPACITY * F.count_if(F.col("n") > 0)).alias("filled"))
    return docs.join(F.broadcast(full))  # one row each


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of one edit in ten words at most, of which those without an edit are asked for."""
    return _leaks(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of ten words of a document with one changed or added, or left out between them."""
    return _leaks(spark, sf_dir)


def p8_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of every item with 17 words or more, planted among other words with one word changed, left out or added: (kind,
    planted, reached), reached if at least 0.9 of a kind are found with an edit."""
    items = _table(spark, sf_dir, "eval_items")
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    part = lambda a, n: F.slice("w", a, n)
    kinds = {
        "changed": [part(1, 4), F.array(F.lit("qqqq")), part(6, 5)],
        "left out": [part(1, 8), part(10, 8)],
        "added": [part(1, 8), F.array(F.lit("qqqq")), part(9, 8)],
    }
    around = [F.array(*[F.lit(f"{side}{i}") for i in range(6)]) for side in ("vor", "nach")]
    rows = items.select("item_id", w.alias("w")).where(F.size("w") >= 17)
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("at"), F.array_join(F.concat(around[0], *pieces, around[1]), " ").alias("text")) for i, (k, pieces) in enumerate(kinds.items())]))
    planted = rows.select("item_id", cases.alias("c")).select((F.col("item_id") * len(kinds) + F.col("c.at")).alias("doc_id"), F.col("item_id").alias("of"), "c.kind", "c.text")
    found = leaks.leaked_items(planted, items).where("edits > 0 AND item_id = doc_id div 3").select("doc_id")
    counts = planted.join(found.withColumn("hit", F.lit(1)), "doc_id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("planted"), F.count("hit").alias("hits"))
    return counts.select("kind", "planted", (F.col("hits") >= 0.9 * F.col("planted")).alias("reached"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return languages.passages(docs, languages.train(docs))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.wrong_labels(languages.held_languages(_passages(spark, sf_dir)))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir)


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.held_languages(_passages(spark, sf_dir))


def p9_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p9_passages, one row: every document is there, its passages cover its sentences one after the other, and
    confidences lie between 0 and 1; and whether LEAST_AGREED of the documents in one language whose label names one of the languages agree."""
    parts = cut_lineage(_passages(spark, sf_dir))
    docs = parts.groupBy("doc_id").agg(F.sum("sentences").alias("n"), F.max("of").alias("of"), F.max(F.col("first") + F.col("sentences")).alias("end"), F.count_distinct("first").alias("firsts"), F.count(F.lit(1)).alias("rows"))
    sure = parts.agg(F.count_if((F.col("sentences") > 0) & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).alias("unsure"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("n") != F.col("of")) | (F.col("end") != F.col("of")) | (F.col("firsts") != F.col("rows"))).alias("gaps"))
    one = languages.held_languages(parts).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang")).where("n = 1 AND label IS NOT NULL")
    agreed = one.agg((F.count_if(F.col("lang") == F.col("label")) >= LEAST_AGREED * F.count(F.lit(1))).alias("agreed"))
    return docs.join(F.broadcast(sure)).join(F.broadcast(agreed))  # one row each


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_look(column: str) -> str:
    """The same mapping in SQL, with composed accents and without signs that have no extent."""
    pairs = confusables.one_to_one()
    out = f"translate({column}, {_sql_text(''.join(pairs))}, {_sql_text(''.join(pairs.values()))})"
    for a, b in confusables.joined().items():
        out = f"replace({out}, {_sql_text(a)}, {_sql_text(b)})"
    return f"nfc_normalize(regexp_replace({out}, '{_SQL_NO_EXTENT}', '', 'g'))"


_SQL_NO_EXTENT = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in confusables._NO_EXTENT) + "]"
_SQL_FORM = "replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{Latin}\\p{Cyrillic}\\p{Greek}]', '.', 'g'), '\\p{Latin}', '1', 'g'), '[^.1]', '2', 'g'), 'x', ''), 'y', '')"


def _sql_unified(rows: str, keys: str) -> str:
    """keys and canonical of rows (keys, text)."""
    odd_letters = _sql_text("".join(c for c in confusables.odd_signs() if c not in confusables.ZERO_WIDTH))
    return f"""
WITH rows AS (SELECT * FROM ({rows})),
spelt AS (SELECT text, {_sql_look('text')} AS look, {_SQL_FORM} AS form FROM (SELECT DISTINCT text FROM rows WHERE text IS NOT NULL)),
weighed AS (SELECT text, look, (len(form) - len(replace(form, '12', ''))) // 2 + (len(form) - len(replace(form, '21', ''))) // 2
  + len(text) - len(translate(regexp_replace(text, '{_SQL_NO_EXTENT}', '', 'g'), {odd_letters}, '')) + len(regexp_extract_all(text, '\\p{{M}}')) AS odd,
  len(regexp_extract_all(text, '[\\p{{Cyrillic}}\\p{{Greek}}]')) AS foreign_ FROM spelt),
best AS (SELECT look, arg_min(text, (odd, foreign_, text)) AS canonical FROM weighed GROUP BY look)
SELECT {keys}, canonical FROM rows LEFT JOIN (SELECT text, canonical FROM weighed JOIN best USING (look)) USING (text)"""


_VALID = """
WITH names AS (SELECT DISTINCT token, token_id FROM token_index),
posted AS (SELECT DISTINCT token_id, doc_id, tf FROM postings WHERE doc_id IN (SELECT doc_id FROM doc_info)),
valid AS (SELECT token, doc_id, CAST(sum(tf) AS BIGINT) AS tf FROM posted JOIN names USING (token_id) GROUP BY token, doc_id),
size AS (SELECT count(DISTINCT doc_id) AS n FROM valid)"""

_SCORES = (
    _VALID
    + """,
stats AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM valid GROUP BY token),
ridf AS (SELECT token, df, cf, log2(n / df) + log2(1 - exp(-cf / n)) AS ridf, greatest(n / df - 1 / (1 - exp(-cf / n)), 0) AS residual FROM stats, size),
scores AS (SELECT v.doc_id, v.token, v.tf, r.df, r.cf, r.ridf, r.residual, v.tf * r.residual AS score FROM valid v JOIN ridf r USING (token)
  WHERE v.doc_id IN (SELECT doc_id FROM feedback_docs))"""
)

_FREQUENCIES = (
    _VALID
    + """,
freq AS (SELECT token, CAST(sum(tf) AS BIGINT) AS occurrences, count(*) AS records FROM valid GROUP BY token),
marked AS (SELECT token, occurrences, records, CASE WHEN records <= 1 THEN 'rare' WHEN records > 0.6 * n THEN 'common' ELSE 'useful' END AS mark FROM freq, size)"""
)

_PLACES = "(rank() OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, {s}) - 1) / 2) / count(*) OVER (PARTITION BY query_id)"

_RANKING = (
    """
WITH ranks AS (SELECT name AS title, max(rank) AS pagerank FROM pageranks GROUP BY name),
titles AS (SELECT DISTINCT doc_id, regexp_replace(name, '^.*/', '') AS title FROM doc_info),
paged AS (SELECT doc_id, max(pagerank) AS pagerank FROM titles JOIN ranks USING (title) GROUP BY doc_id),
items AS (SELECT query_id, r.doc_id, max(tfidf) AS tfidf, max(hub) AS hub, max(authority) AS authority, max(pagerank) AS pagerank
  FROM run_scores r LEFT JOIN paged p ON p.doc_id = r.doc_id GROUP BY query_id, r.doc_id),
placed AS (SELECT query_id, doc_id, """
    + ", ".join(f"CASE WHEN {s} IS NULL THEN 1.0 ELSE {_PLACES.format(s=s)} END AS {p}" for s, p in zip(["tfidf", "hub", "authority", "pagerank"], "abcd", strict=True))
    + """ FROM items),
sorted AS (SELECT query_id, doc_id, (a + b + c + d) / 4 AS mean_place, list_sort([a, b, c, d]) AS x FROM placed),
tails AS (SELECT query_id, doc_id, mean_place,
  4 * least(1 - pow(1 - x[1], 4), 6 * pow(x[2], 2) * pow(1 - x[2], 2) + 4 * pow(x[2], 3) * (1 - x[2]) + pow(x[2], 4), 4 * pow(x[3], 3) * (1 - x[3]) + pow(x[3], 4), pow(x[4], 4)) AS rho FROM sorted),
ranked AS (SELECT query_id, doc_id, least(1.0, rho) AS rho, mean_place, row_number() OVER (PARTITION BY query_id ORDER BY least(1.0, rho), mean_place, doc_id) AS position FROM tails)"""
)

_WINDOWS = "SELECT {i} AS id, array_to_string(w[p : p + 9], ' ') AS words FROM (SELECT {i}, w, unnest(range(1, len(w) - 8)) AS p FROM (SELECT {i}, regexp_extract_all(lower({look}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t}) WHERE len(w) >= 10)"

QUERIES = {
    "p3_found": p3_found, "p3_scores": p3_scores, "p4_found": p4_found, "p4_frequencies": p4_frequencies, "p4_containers": p4_containers,
    "p5_found": p5_found, "p5_lines": p5_lines, "p5_classes": p5_classes, "p5_passages": p5_passages, "p6_found": p6_found, "p6_ranking": p6_ranking,
    "p7_containers": p7_containers, "p7_checked": p7_checked, "p8_found": p8_found, "p8_near": p8_near, "p8_recall": p8_recall, "p9_found": p9_found, "p9_passages": p9_passages, "p9_documents": p9_documents, "p9_checked": p9_checked,
}

SQL = {
    "p3_found": _SCORES + " SELECT doc_id, token FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, token) = 1",
    "p3_scores": _SCORES + " SELECT doc_id, token, tf, df, cf, round(ridf, 6) AS ridf, round(residual, 6) AS residual, round(score, 6) AS score FROM scores",
    "p4_found": _FREQUENCIES + " SELECT token, mark FROM marked WHERE mark <> 'useful'",
    "p4_frequencies": _FREQUENCIES + " SELECT token, occurrences, records, mark FROM marked",
    "p4_containers": _VALID
    + """, runs AS (SELECT token, doc_id // 4096 AS container, doc_id % 4096 AS o, tf, doc_id % 4096 <> 1 + coalesce(lag(doc_id % 4096) OVER (PARTITION BY token, doc_id // 4096 ORDER BY doc_id), -9) AS opens FROM valid),
held AS (SELECT token, container, count(*) AS records, CAST(sum(tf) AS BIGINT) AS occurrences, 2 * count(*) AS a, 4 * count(*) FILTER (WHERE opens) AS r, CAST(sum(o) AS BIGINT) AS s FROM runs GROUP BY token, container)
SELECT token, container, CASE WHEN a <= r AND a <= 512 THEN 'array' WHEN r <= 512 THEN 'run' ELSE 'bitmap' END AS kind, least(a, r, 512) AS bytes, records, occurrences, CASE WHEN least(a, r) <= 512 THEN s END AS checksum FROM held""",
    "p5_found": f"WITH m AS (SELECT line_id, text, {_sql_look('text')} AS look FROM tokenizer_lines) SELECT DISTINCT a.line_id AS line_a, b.line_id AS line_b FROM m a JOIN m b ON a.look = b.look AND a.line_id < b.line_id AND a.text <> b.text",
    "p5_classes": f"""WITH m AS (SELECT line_id, text, {_sql_look('text')} AS look FROM tokenizer_lines WHERE text IS NOT NULL),
n AS (SELECT *, count(*) OVER (PARTITION BY look) - count(*) OVER (PARTITION BY look, text) AS links FROM m), c AS ({_sql_unified("SELECT line_id, text FROM tokenizer_lines", "line_id")})
SELECT line_id, md5(canonical) AS class_id, links FROM n JOIN c USING (line_id) WHERE links > 0""",
    "p5_lines": _sql_unified("SELECT line_id, text FROM tokenizer_lines", "line_id"),
    "p5_passages": _sql_unified("SELECT doc_id, passage, text FROM (SELECT doc_id, unnest(w) AS text, CAST(unnest(range(len(w))) AS INTEGER) AS passage FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS w FROM documents)) WHERE len(text) > 0", "doc_id, passage"),
    "p6_found": _RANKING + " SELECT query_id, doc_id FROM ranked WHERE position <= 10",
    "p6_ranking": _RANKING + " SELECT query_id, doc_id, round(rho, 9) AS rho, round(mean_place, 9) AS mean_place FROM ranked",
    "p7_checked": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS over, true AS filled FROM documents",
    "p9_checked": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS unsure, true AS agreed FROM documents",
    "p8_found": f"WITH d AS ({_WINDOWS.format(i='doc_id', look=_sql_look('text'), t='documents')}), i AS ({_WINDOWS.format(i='item_id', look=_sql_look('text'), t='eval_items')}) SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i USING (words)",
    "p8_recall": "SELECT kind, count(*) AS planted, true AS reached FROM eval_items, (VALUES ('changed'), ('left out'), ('added')) AS k(kind) WHERE len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) >= 17 GROUP BY kind",
}
