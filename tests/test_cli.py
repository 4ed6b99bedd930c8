from siftwell.__main__ import main
from siftwell.operators.walks import sweep


def test_commands(spark, tmp_path, capsys):
    docs = tmp_path / "docs" / "wiki"
    docs.mkdir(parents=True)
    for name, text in (("A.f", "The queen of England, 3.14"), ("B.f", "the queen of the north"), ("C.f", "money")):
        (docs / name).write_text(text)
    (tmp_path / "links").write_text("1;2,\n2;1,3,\n4;\n")
    (tmp_path / "titles").write_text("1;A.f\n2;B.f\n3;C.f\n4;D.f\n")
    (tmp_path / "ranks").write_text("A.f;0.5\nB.f;0.3\n")
    (tmp_path / "patterns").write_text("\\d+\\.\\d+\n")

    def run(*args):
        main([str(a) for a in args], spark)
        return capsys.readouterr().out.split("\n")[:-1]

    assert run("tokens", docs, "--patterns", tmp_path / "patterns") == "the queen of england 3.14 the queen of the north money".split()
    assert run("tokens", docs, "--keep-case", "--keep-punctuation")[:6] == ["The", "queen", "of", "England", ",", "3"]
    run("index", docs, tmp_path / "ix")
    assert [x.rpartition("/")[2].split()[0] for x in run("search", tmp_path / "ix", "queen of", "--type", "phrase")[:-1]] == ["A.f", "B.f"]
    assert len(run("search", tmp_path / "ix", "north money")[:-1]) == 2
    assert run("search", tmp_path / "ix", "queen", "--ranking", "pagerank", "--pageranks", tmp_path / "ranks", "--top", 1)[0].endswith("0.62500")
    assert len(run("search", tmp_path / "ix", "queen", "--ranking", "hits", "--links", tmp_path / "links", "--titles", tmp_path / "titles")) == 4
    assert run("suggest", tmp_path / "ix", "quen")[0].startswith("queen ")
    assert run("kgrams", tmp_path / "ix", "^q", "n$") == ["1 terms", "queen"]
    shown = run("pagerank", tmp_path / "links", "--titles", tmp_path / "titles", "--out", tmp_path / "pr", "--iterations", 40)
    assert len(shown) == 4 and shown[0].startswith("B.f: 0.3") and spark.read.text(str(tmp_path / "pr")).count() == 4
    assert len(run("hits", tmp_path / "links", "--iterations", 3)) == 8
    assert len(run("walks", tmp_path / "links", "--walks", 1000)) == 4


def test_sweep():
    assert sweep(903)[:3] == [100, 200, 300] and sweep(903)[-1] == 100_000
