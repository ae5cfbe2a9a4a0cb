import pandas as pd
from helpers import DATA, same, sql_rows

from spandrel.llm import quality_rules


def brute(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    plain = " ".join(f"wort{i}" for i in range(60))
    return [None, "", " \x0b\x0c\r\n\t", "a", "a b", "a a a a", "é|x y <z>\n\n\na\n a\na\n", plain, plain + ".\n" + plain, "x y z " * 40, "a b c d a b c e " + plain, plain * 30, plain, "&&& " * 70]


def test_base_and_sql(spark):
    rows = [(i, t, "q") for i, t in enumerate(texts())] + [(None, "a b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string")
    got = quality_rules.judge(docs)
    for r in got.where("doc_id is not null").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(rows[r.doc_id][1])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    same(got, sql_rows(quality_rules.sql(), views={"documents": pd.DataFrame(rows, columns=["doc_id", "text", "votes"]).astype({"doc_id": "Int64"})}))


def test_driver_tables(spark):
    same(quality_rules.judge(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")), sql_rows(quality_rules.sql()))


def test_empty_table(spark):
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
