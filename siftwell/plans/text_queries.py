"""Queries on tokens, the index, retrieval, wildcards, spelling and feedback over documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import feedback, retrieval, spelling, wildcard
from siftwell.operators.graph import clean_edges
from siftwell.operators.index import Index, append, compact, dense_ids, document_frequency, token_table
from siftwell.plans.records import node_id, table
from siftwell.plans.search import Searcher, parse
from siftwell.session import exists, scratch_dir
from siftwell.streaming.ingest import document_stream, index_stream, read_stream_index

QUERY = "library harbour ferry"
PHRASE = "the night ferry"
WILD_QUERY = "libr*y th* harbour"
WILD_PHRASE = "the n*ght ferry"
MISSPELT = ["librery", "tickts"]

#: Words of other kinds that stand in these documents, chosen for them: web addresses, mail, days, times, amounts, numbers in groups, joined words.
PATTERNS = [r"https?://[^\s<>|]+", r"[a-z0-9._-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{1,2}:[0-9]{2}", r"[$][0-9][0-9.,]*[0-9]", r"[0-9]+(?:[.,][0-9]+)+", r"\p{L}+(?:[-'/]\p{L}+)+"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "fetched_at")


def index(spark: SparkSession, sf_dir: str) -> Index:
    return Index.build(documents(spark, sf_dir))


_stored: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str) -> Index:
    """Writes the index of the documents, and reads it."""
    path = scratch_dir(spark)
    index(spark, sf_dir).write(path)
    _stored[(spark.sparkContext.applicationId, sf_dir)] = path
    return Index.read(spark, path)


def stored(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents, written by the first query of an application that asks for it."""
    path = _stored.get((spark.sparkContext.applicationId, sf_dir))
    return Index.read(spark, path) if path and exists(spark, path) else store(spark, sf_dir)


def searcher(spark: SparkSession, sf_dir: str) -> Searcher:
    info = table(spark, sf_dir, "doc_info").select("doc_id", T.base_name(F.col("name")).alias("title")).dropna().distinct()
    ranks = table(spark, sf_dir, "pageranks").groupBy(F.col("name").alias("title")).agg(F.max("rank").alias("rank"))
    of_doc = info.join(ranks, "title").groupBy("doc_id").agg(F.max("rank").alias("rank"))
    edges = clean_edges(table(spark, sf_dir, "link_edges"), node_id("src"), node_id("dst"))
    titles = table(spark, sf_dir, "page_titles").select(node_id("node_id").alias("node"), "title").dropna().distinct()
    return Searcher(spark, stored(spark, sf_dir), of_doc, edges, titles, info)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _tokens(**how):
    return lambda spark, d: token_table(documents(spark, d), words=T.tokens(F.col("text"), **how))


def tok_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(documents(spark, sf_dir), words=T.pattern_tokens(PATTERNS)(F.col("text")))


def _postings(ix: Index) -> DataFrame:
    return ix.postings.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def idx_term_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_ids(index(spark, sf_dir).terms, "term", "term_id").select("term", "term_id")


def idx_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with its dictionary and k-grams, and read again."""
    return _postings(store(spark, sf_dir))


def idx_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored dictionary."""
    return stored(spark, sf_dir).dictionary


def idx_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in by year, each year's partial index is appended, and the whole is compacted."""
    docs, path = documents(spark, sf_dir), scratch_dir(spark)
    year = F.coalesce(F.year("fetched_at"), F.lit(0))
    for part in (year < 2020, year >= 2020):
        append(Index.build(docs.where(part)), path)
    return _postings(compact(spark, path, path + "/whole"))


def idx_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    year = F.coalesce(F.year("fetched_at"), F.lit(0))
    return _postings(Index.build(docs.where(year < 2020)).merged(Index.build(docs.where(year >= 2020))))


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index from a stream of document files."""
    docs, path = documents(spark, sf_dir), scratch_dir(spark)
    docs.write.parquet(path + "/in")
    query = index_stream(document_stream(spark, path + "/in", docs.schema), path, path + "/state")
    query.awaitTermination()
    return _postings(read_stream_index(spark, path))


def idx_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).lookup("library").select("doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


def _search(query: str, kind: str, ranking: str = "tfidf"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = searcher(spark, sf_dir).search(query, kind, ranking)
        return _rounded(found) if kind == "ranked" else found

    return run


def ret_tfidf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(searcher(spark, sf_dir).search_terms([("library", 2.0), ("ferry", 0.5), ("library", 1.0)]))


def ret_tfidf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix, terms = stored(spark, sf_dir), parse(QUERY)
    literal = [t for t, _ in terms]
    return _rounded(retrieval.tfidf(ix, retrieval.matched(ix, retrieval.literal_slots(spark, terms), literal), True, literal))


def ret_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of results."""
    return _rounded(searcher(spark, sf_dir).search(QUERY).limit(10))


def ret_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(searcher(spark, sf_dir).search(QUERY).offset(10).limit(10))


def ret_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.missing_terms(stored(spark, sf_dir), ["library", "zzzunknown"])


def kgram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).kgrams().select("kgram", "term")


def kgram_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wildcard.kgram_intersection(stored(spark, sf_dir).kgrams(), ["^b", "ar", "y$"])


def wild_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wildcard.expand(stored(spark, sf_dir).kgrams(), "b*ry")


def spell_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.overlaps(spark, stored(spark, sf_dir).kgrams(), MISSPELT).where(F.col("jaccard") >= spelling.LEAST_JACCARD)
    return found.select("word", "term", F.round("jaccard", 6).alias("jaccard"))


def spell_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.candidates(spark, stored(spark, sf_dir).kgrams(), MISSPELT)
    return found.select("word", "term", "df", F.col("edits").cast("bigint").alias("edits"))


def spell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.scored(spelling.candidates(spark, stored(spark, sf_dir).kgrams(), MISSPELT))
    return found.select("ord", "term", F.round("score", 6).alias("score"))


def spell_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.suggest(spark, stored(spark, sf_dir).kgrams(), MISSPELT)
    return found.select("suggestion", F.round("score", 6).alias("score"))


def fb_rocchio(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = feedback.rocchio(spark, stored(spark, sf_dir), parse(QUERY), table(spark, sf_dir, "feedback_docs"))
    return weights.select("term", F.round("weight", 6).alias("weight"))


def fb_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(searcher(spark, sf_dir).with_feedback(QUERY, table(spark, sf_dir, "feedback_docs")))


def prj_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return table(spark, sf_dir, "doc_info").select("doc_id", T.base_name(name).alias("base"), T.without_first_piece(name).alias("rest"), T.shortened(name, 20).alias("shown"), F.format_string("%.3f", F.coalesce("length", F.lit(0)).cast("double")).alias("length"))


QUERIES = {
    "tok_standard": _tokens(), "tok_case": _tokens(case_folding=False), "tok_keep_punct": _tokens(punctuation=True), "tok_accents": _tokens(accents=False), "tok_patterns": tok_patterns,
    "idx_postings": lambda s, d: _postings(index(s, d)), "idx_doc_length": lambda s, d: index(s, d).docs, "idx_doc_freq": lambda s, d: document_frequency(index(s, d).postings),
    "idx_term_ids": idx_term_ids, "idx_terms": idx_terms, "idx_lookup": idx_lookup, "idx_parquet": idx_parquet, "idx_incremental": idx_incremental, "idx_merge": idx_merge, "stream_index": stream_index,
    "ret_term": _search("library", "intersection"), "ret_intersection": _search("library ferry", "intersection"), "ret_phrase": _search(PHRASE, "phrase"), "ret_tfidf": _search(QUERY, "ranked"),
    "ret_tfidf_weighted": ret_tfidf_weighted, "ret_tfidf_exact": ret_tfidf_exact, "ret_top": ret_top, "ret_next_page": ret_next_page, "ret_missing": ret_missing,
    "ret_unknown_word": _search("library zzzunknown", "ranked"), "ret_pagerank": _search(QUERY, "ranked", "pagerank"), "ret_combination": _search(QUERY, "ranked", "combination"), "ret_hits": _search(QUERY, "ranked", "hits"),
    "wild_expand": wild_expand, "wild_single": _search("libr*", "intersection"), "wild_intersection": _search(WILD_QUERY, "intersection"), "wild_phrase": _search(WILD_PHRASE, "phrase"), "wild_ranked": _search(WILD_QUERY, "ranked"),
    "kgram_index": kgram_postings, "kgram_intersect": kgram_intersect,
    "spell_overlap": spell_overlap, "spell_candidates": spell_candidates, "spell_scores": spell_scores, "spell_suggest": spell_suggest,
    "fb_rocchio": fb_rocchio, "fb_search": fb_search, "prj_names": prj_names,
}


def _tok(text: str = "lower(text)", pattern: str = T.STANDARD) -> str:
    return f"""
WITH toks AS (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS w FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, unnest(w) AS term, CAST(unnest(range(len(w))) AS INTEGER) AS pos FROM toks)"""


_IDX = (
    _tok()
    + """,
post AS (SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM tokens GROUP BY term, doc_id),
docs AS (SELECT d.doc_id, CAST(coalesce(len(w), 0) AS INTEGER) AS length FROM documents d LEFT JOIN toks t ON t.doc_id = d.doc_id),
vocab AS (SELECT term, count(*) AS df FROM post GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)"""
)

# The accented letters in the order of Unicode, and the letters they are read as.
_ACCENTED = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿĀāĂăĄąĆćĈĉĊċČčĎďĐđĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĦħĨĩĪīĬĭĮįİıĲĳĴĵĶķĸĹĺĻļĽľĿŀŁłŃńŅņŇňŉŊŋŌōŎŏŐőŒœŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŦŧŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
_PLAIN = "AAAAAAECEEEEIIIIDNOOOOOOUUUUYTSaaaaaaeceeeeiiiidnoooooouuuuytyAaAaAaCcCcCcCcDdDdEeEeEeEeEeGgGgGgGgHhHhIiIiIiIiIiIiJjKkkLlLlLlLlLlNnNnNnnNnOoOoOoOoRrRrRrSsSsSsSsTtTtTtUuUuUuUuUuUuWwYyYZzZzZz"
_ACCENTS = f"lower(translate(text, '{_ACCENTED}', '{_PLAIN}'))"


def _patterns_sql() -> str:
    """Chunk by chunk: the first pattern that occurs, what stands before it, and on with the rest."""
    quoted = [p.replace("'", "''") for p in PATTERNS]
    which = "CASE " + " ".join(f"WHEN regexp_extract(rest, '{p}') <> '' THEN {i}" for i, p in enumerate(quoted)) + " END"
    found = "CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(rest, '{p}')" for i, p in enumerate(quoted)) + " END"
    before = "CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(rest, '(?s)^(.*?)(?:{p})', 1)" for i, p in enumerate(quoted)) + " END"
    return f"""
WITH RECURSIVE chunks AS (SELECT doc_id, unnest(c) AS chunk, unnest(range(len(c))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}!-~]+') AS c FROM documents WHERE text IS NOT NULL)),
steps AS (SELECT doc_id, i, CAST([] AS VARCHAR[]) AS words, chunk AS rest FROM chunks
  UNION ALL SELECT doc_id, i, list_concat(words, regexp_extract_all(coalesce(b, rest), '{T.STANDARD}'), CASE WHEN h IS NULL THEN [] ELSE [h] END), CASE WHEN h IS NULL THEN '' ELSE substr(rest, len(b) + len(h) + 1) END
  FROM (SELECT *, {found} AS h, {before} AS b FROM (SELECT *, {which} AS k FROM steps WHERE rest <> ''))),
whole AS (SELECT doc_id, flatten(list(words ORDER BY i)) AS w FROM steps WHERE rest = '' GROUP BY doc_id)
SELECT doc_id, unnest(w) AS term, CAST(unnest(range(len(w))) AS INTEGER) AS pos FROM whole"""


def _slots(terms: list[tuple[int, str, float]]) -> str:
    return ", slots(ord, term, weight) AS (VALUES " + ", ".join(f"({i}, '{t}', {float(w)})" for i, t, w in terms) + ")"


def _query(q: str) -> str:
    return _slots([(i, t, w) for i, (t, w) in enumerate(parse(q))])


def _wild(q: str) -> str:
    """Slots of a query with wildcards, by a plain scan of the vocabulary."""
    parts = []
    for i, (t, _) in enumerate(parse(q)):
        a, star, b = t.partition("*")
        parts.append(f"SELECT {i} AS ord, term, 1.0 AS weight FROM vocab WHERE starts_with(term, '{a}') AND ends_with(term, '{b}')" if star else f"SELECT {i}, '{t}', 1.0")
    return ", slots(ord, term, weight) AS (" + " UNION ALL ".join(parts) + ")"


_TFIDF = """, scored AS (SELECT p.doc_id, sum(s.weight * p.tf * ln({ratio})) AS total FROM post p JOIN slots s USING (term) JOIN vocab v USING (term), n GROUP BY p.doc_id),
ranked AS (SELECT doc_id, total / length AS score FROM scored JOIN docs USING (doc_id))"""
_FLOOR, _EXACT = _TFIDF.format(ratio="n.n // v.df"), _TFIDF.format(ratio="n.n / v.df")
_SHOW = " SELECT doc_id, round(score, 6) AS score FROM ranked"
_BOTH = " SELECT doc_id FROM post JOIN slots USING (term) GROUP BY doc_id HAVING count(DISTINCT ord) = (SELECT count(DISTINCT ord) FROM slots)"
_ROW = " SELECT DISTINCT doc_id FROM (SELECT doc_id, pos - ord AS start FROM tokens JOIN slots USING (term) GROUP BY doc_id, pos - ord HAVING count(DISTINCT ord) = (SELECT count(DISTINCT ord) FROM slots))"

_RANKS = """, named AS (SELECT DISTINCT doc_id, regexp_extract(name, '[^/]+$') AS title FROM doc_info),
pr AS (SELECT doc_id, max(rank) AS rank FROM named JOIN pageranks p ON p.name = named.title GROUP BY doc_id)"""

_GRAMS = """, framed AS (SELECT term, df, '^' || term || '$' AS f FROM vocab), grams AS (SELECT term, df, list_distinct([f[i : i + 1] FOR i IN range(1, len(f))]) AS g FROM framed)"""


def _hits_sql(steps: int) -> str:
    out = """, edges AS MATERIALIZED (SELECT DISTINCT CAST(trim(src) AS BIGINT) AS src, CAST(trim(dst) AS BIGINT) AS dst FROM link_edges WHERE src IS NOT NULL AND dst IS NOT NULL),
titled AS MATERIALIZED (SELECT DISTINCT CAST(trim(node_id) AS BIGINT) AS node, title FROM page_titles),
root AS MATERIALIZED (SELECT DISTINCT node FROM post JOIN slots USING (term) JOIN named USING (doc_id) JOIN titled USING (title)),
base AS MATERIALIZED (SELECT node FROM root UNION SELECT dst FROM edges WHERE src IN (SELECT node FROM root) UNION SELECT src FROM edges WHERE dst IN (SELECT node FROM root)),
ahead AS MATERIALIZED (SELECT * FROM edges WHERE src IN (SELECT node FROM base)), behind AS MATERIALIZED (SELECT * FROM edges WHERE dst IN (SELECT node FROM base)),
raw0 AS MATERIALIZED (SELECT node, CAST((SELECT count(*) FROM ahead WHERE src = node) AS DOUBLE) AS h, CAST((SELECT count(*) FROM behind WHERE dst = node) AS DOUBLE) AS a FROM base),
v0 AS MATERIALIZED (SELECT node, h / (SELECT sqrt(sum(h * h)) FROM raw0) AS h, a / (SELECT sqrt(sum(a * a)) FROM raw0) AS a FROM raw0)"""
    for k in range(1, steps):
        out += f""",
h{k} AS MATERIALIZED (SELECT src AS node, sum(v.a) AS h FROM ahead JOIN v{k - 1} v ON v.node = dst GROUP BY src), a{k} AS MATERIALIZED (SELECT dst AS node, sum(v.h) AS a FROM behind JOIN v{k - 1} v ON v.node = src GROUP BY dst),
raw{k} AS MATERIALIZED (SELECT base.node, coalesce(h, 0) AS h, coalesce(a, 0) AS a FROM base LEFT JOIN h{k} USING (node) LEFT JOIN a{k} USING (node)),
v{k} AS MATERIALIZED (SELECT node, h / (SELECT sqrt(sum(h * h)) FROM raw{k}) AS h, a / (SELECT sqrt(sum(a * a)) FROM raw{k}) AS a FROM raw{k})"""
    return out + f", ranked AS (SELECT doc_id, max(greatest(h, a)) AS score FROM v{steps - 1} JOIN titled USING (node) JOIN named USING (title) GROUP BY doc_id)"


_CANDIDATES = (
    _IDX
    + _GRAMS
    + ", asked AS (SELECT ord, word, list_distinct([f[i : i + 1] FOR i IN range(1, len(f))]) AS g FROM (SELECT *, '^' || word || '$' AS f FROM (VALUES "
    + ", ".join(f"({i}, '{w}')" for i, w in enumerate(MISSPELT))
    + """) AS w(ord, word))),
overlap AS MATERIALIZED (SELECT ord, word, term, df, len(list_intersect(q.g, t.g)) / (len(q.g) + len(t.g) - len(list_intersect(q.g, t.g))) AS jaccard FROM asked q JOIN grams t ON list_has_any(q.g, t.g)),
near AS MATERIALIZED (SELECT * FROM overlap WHERE jaccard >= 0.4),
cut AS MATERIALIZED (SELECT *, [word[1 : i - 1] || word[i + 1 :] FOR i IN range(1, len(word) + 1)] AS w1, [term[1 : i - 1] || term[i + 1 :] FOR i IN range(1, len(term) + 1)] AS t1 FROM near),
cut2 AS MATERIALIZED (SELECT *, flatten([[x[1 : i - 1] || x[i + 1 :] FOR i IN range(1, len(x) + 1)] FOR x IN w1]) AS w2, flatten([[x[1 : i - 1] || x[i + 1 :] FOR i IN range(1, len(x) + 1)] FOR x IN t1]) AS t2 FROM cut),
cand AS MATERIALIZED (SELECT ord, word, term, df, jaccard, CASE WHEN word = term THEN 0 WHEN list_contains(w1, term) OR list_contains(t1, word) THEN 1
  WHEN list_contains(w2, term) OR list_contains(t2, word) OR list_has_any(w1, t1) THEN 2 ELSE 3 END AS edits FROM cut2),
kept AS MATERIALIZED (SELECT * FROM cand WHERE edits <= 2),
score AS MATERIALIZED (SELECT ord, term, jaccard / sum(jaccard) OVER (PARTITION BY ord) + df / sum(df) OVER (PARTITION BY ord) AS score FROM kept)"""
)

_FEEDBACK = (
    _IDX
    + _query(QUERY)
    + """, marked AS (SELECT DISTINCT doc_id FROM feedback_docs),
parts AS (SELECT term, weight / (SELECT count(*) FROM slots) AS part FROM slots
  UNION ALL SELECT term, 0.75 * sum(tf) / (SELECT count(*) FROM marked) FROM post WHERE doc_id IN (SELECT doc_id FROM marked) GROUP BY term),
weights AS (SELECT term, sum(part) * ln(any_value(n.n) / any_value(df)) AS weight FROM parts JOIN vocab USING (term), n GROUP BY term)"""
)

_ALL_POSTINGS = _IDX + " SELECT term, doc_id, tf, positions FROM post"

SQL = {
    "tok_standard": _tok() + " SELECT doc_id, pos, term FROM tokens",
    "tok_case": _tok("text") + " SELECT doc_id, pos, term FROM tokens",
    "tok_keep_punct": _tok(pattern=T.KEPT) + " SELECT doc_id, pos, term FROM tokens",
    "tok_accents": _tok(_ACCENTS) + " SELECT doc_id, pos, term FROM tokens",
    "tok_patterns": _patterns_sql(),
    "idx_postings": _ALL_POSTINGS,
    "idx_parquet": _ALL_POSTINGS,
    "idx_incremental": _ALL_POSTINGS,
    "idx_merge": _ALL_POSTINGS,
    "stream_index": _ALL_POSTINGS,
    "idx_doc_length": _IDX + " SELECT doc_id, 'docs/' || doc_id AS name, length FROM docs",
    "idx_doc_freq": _IDX + " SELECT term, df FROM vocab",
    "idx_terms": _IDX + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term",
    "idx_term_ids": _IDX + " SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM vocab",
    "idx_lookup": _IDX + " SELECT doc_id, tf, positions FROM post WHERE term = 'library'",
    "ret_term": _IDX + _query("library") + _BOTH,
    "ret_intersection": _IDX + _query("library ferry") + _BOTH,
    "ret_phrase": _IDX + _query(PHRASE) + _ROW,
    "ret_tfidf": _IDX + _query(QUERY) + _FLOOR + _SHOW,
    "ret_tfidf_weighted": _IDX + _slots([(0, "library", 2.0), (1, "ferry", 0.5), (2, "library", 1.0)]) + _FLOOR + _SHOW,
    "ret_tfidf_exact": _IDX + _query(QUERY) + _EXACT + _SHOW,
    "ret_top": _IDX + _query(QUERY) + _FLOOR + _SHOW + " ORDER BY ranked.score DESC, doc_id LIMIT 10",
    "ret_next_page": _IDX + _query(QUERY) + _FLOOR + _SHOW + " ORDER BY ranked.score DESC, doc_id LIMIT 10 OFFSET 10",
    "ret_missing": _IDX + " SELECT term FROM (VALUES ('library'), ('zzzunknown')) AS q(term) WHERE term NOT IN (SELECT term FROM vocab)",
    "ret_unknown_word": _IDX + _query("library zzzunknown") + _FLOOR + _SHOW + " WHERE (SELECT count(*) FROM slots WHERE term NOT IN (SELECT term FROM vocab)) = 0",
    "ret_pagerank": _IDX + _query(QUERY) + _RANKS + ", found AS (SELECT DISTINCT doc_id FROM post JOIN slots USING (term)), ranked AS (SELECT f.doc_id, coalesce(rank, 0) / sum(rank) OVER () AS score FROM found f LEFT JOIN pr USING (doc_id))" + _SHOW,
    "ret_combination": _IDX + _query(QUERY) + _FLOOR + _RANKS + " SELECT r.doc_id, round(0.1 * score / sum(score) OVER () + 0.9 * coalesce(rank, 0) / sum(rank) OVER (), 6) AS score FROM ranked r LEFT JOIN pr USING (doc_id)",
    "ret_hits": _IDX + _query(QUERY) + _RANKS + _hits_sql(5) + _SHOW,
    "wild_expand": _IDX + " SELECT term FROM vocab WHERE starts_with(term, 'b') AND ends_with(term, 'ry')",
    "wild_single": _IDX + _wild("libr*") + _BOTH,
    "wild_intersection": _IDX + _wild(WILD_QUERY) + _BOTH,
    "wild_phrase": _IDX + _wild(WILD_PHRASE) + _ROW,
    "wild_ranked": _IDX + _wild(WILD_QUERY).replace("slots(", "expanded(") + ", slots AS (SELECT DISTINCT 0 AS ord, term, 1.0 AS weight FROM expanded)" + _FLOOR + _SHOW,
    "kgram_index": _IDX + _GRAMS + " SELECT unnest(g) AS kgram, term FROM grams",
    "kgram_intersect": _IDX + " SELECT term FROM vocab WHERE starts_with(term, 'b') AND contains(term, 'ar') AND ends_with(term, 'y')",
    "spell_overlap": _CANDIDATES + " SELECT word, term, round(jaccard, 6) AS jaccard FROM near",
    "spell_candidates": _CANDIDATES + " SELECT word, term, df, CAST(edits AS BIGINT) AS edits FROM kept",
    "spell_scores": _CANDIDATES + " SELECT ord, term, round(score, 6) AS score FROM score",
    "spell_suggest": _CANDIDATES + " SELECT a.term || ' ' || b.term AS suggestion, round(a.score + b.score, 6) AS score FROM score a JOIN score b ON a.ord = 0 AND b.ord = 1 ORDER BY a.score + b.score DESC, 1 LIMIT 10",
    "fb_rocchio": _FEEDBACK + " SELECT term, round(weight, 6) AS weight FROM weights",
    "fb_search": _FEEDBACK + _FLOOR.replace("JOIN slots s", "JOIN weights s") + _SHOW,
    "prj_names": "SELECT doc_id, regexp_extract(name, '[^/]+$') AS base, regexp_replace(name, '^[^/]*/', '') AS rest, CASE WHEN len(name) > 20 THEN name[1:20] || '...' ELSE name END AS shown, printf('%.3f', CAST(coalesce(length, 0) AS DOUBLE)) AS length FROM doc_info",
}
