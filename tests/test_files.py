from pyspark.sql import functions as F

from siftwell.sources import files
from siftwell.streaming.ingest import document_stream, index_stream, read_stream_index


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark, tmp_path):
    put(tmp_path / "d/b/one.f", "Å\nline")
    put(tmp_path / "d/a.f", " ")
    put(tmp_path / "d/none.f", "")
    got = files.read_documents(spark, str(tmp_path / "d")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.name.rpartition("/")[2], r.text) for r in got] == [(0, "a.f", " "), (1, "one.f", "Å\nline")]
    assert files.find_document(files.read_documents(spark, str(tmp_path / "d")), "one.f").count() == 1


def test_links(spark, tmp_path):
    edges, nodes = files.read_links(spark, put(tmp_path / "l", "1;2,3,\n2;\n3;1,1, 4,\n\n5\n"))
    assert rows(edges) == [("1", "2"), ("1", "3"), ("3", "1"), ("3", "4")] and len(rows(nodes)) == 5
    assert files.read_links(spark, str(tmp_path / "l"), 1)[0].count() == 2


def test_small_formats(spark, tmp_path):
    assert rows(files.read_titles(spark, put(tmp_path / "t", "1;a;b\n2;c\n"))) == [("1", "a;b"), ("2", "c")]
    assert rows(files.read_pageranks(spark, put(tmp_path / "p", "a;b.f;0.25\nc;x\n"))) == [("a;b.f", 0.25), ("c", None)]
    assert rows(files.read_reference(spark, put(tmp_path / "r", "7;0.5\n"))) == [(7, 0.5)]
    assert rows(files.read_doc_info(spark, put(tmp_path / "i", "3;x;y.f;12\n"))) == [(3, "x;y.f", 12)]
    assert rows(files.read_token_index(spark, put(tmp_path / "k", "queen 4\n"))) == [("queen", 4)]
    assert rows(files.read_judgements(spark, put(tmp_path / "q", "1 Two Words.f 3\n1 A.f 0\nbroken\n"))) == [(1, "A.f", 0), (1, "Two Words.f", 3)]
    assert rows(files.read_series(spark, put(tmp_path / "s", "1000,1.5E-3\n"))) == [(1000, 0.0015)]
    assert files.read_pattern_file(put(tmp_path / "pat", "// no\n\\d+\n\n([\n\\w+\n")) == [r"\d+"]


def test_sinks(spark, tmp_path):
    ranks = spark.createDataFrame([(1, 0.25), (2, 0.75), (3, 0.25)], "node bigint, rank double")
    titles = spark.createDataFrame([(1, "one"), (2, "two")], "node bigint, title string")
    files.write_pageranks(ranks, titles, str(tmp_path / "pr"))
    assert rows(files.read_pageranks(spark, str(tmp_path / "pr"))) == [("null", 0.25), ("one", 0.25), ("two", 0.75)]
    files.write_top(ranks, "node", "rank", str(tmp_path / "top"), 2)
    assert [r.value for r in spark.read.text(str(tmp_path / "top")).collect()] == ["2: 0.75000", "1: 0.25000"]
    files.write_goodness(spark.createDataFrame([(10, 0.5)], "n bigint, value double"), str(tmp_path / "g"))
    assert rows(files.read_series(spark, str(tmp_path / "g"))) == [(10, 0.5)]
    assert files.top_lines(ranks.limit(0), "node", "rank").count() == 0


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (3, None)], "doc_id bigint, text string")
    folder, path = str(tmp_path / "in"), str(tmp_path / "ix")
    for part in ("doc_id = 1", "doc_id > 1"):
        docs.where(part).write.mode("append").parquet(folder)
        index_stream(document_stream(spark, folder, docs.schema), path, str(tmp_path / "state")).awaitTermination()
    ix = read_stream_index(spark, path)
    assert rows(ix.postings.select("term", "doc_id")) == [("a", 1), ("b", 1), ("b", 2)] and ix.docs.count() == 3
    assert ix.docs.where(F.col("length") == 0).count() == 1
