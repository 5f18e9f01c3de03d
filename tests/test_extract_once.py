from lodemap.operators import extract as X

SCHEMA = "repo_id long, path string, language string, content string"


def test_texts_are_written_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(X, "cut", lambda df, cut=X.cut: calls.append(1) or cut(df))
    X.extract(spark.createDataFrame([(1, "a.ts", "typescript", "export function f(a) {\n  g(a);\n}\n")], SCHEMA))
    assert len(calls) == 3  # the texts, the marks of code and the other lines; texts were written for each of both
