import duckdb
import pytest

from bitloom.plans.oracles import ORACLES
from bitloom.plans.queries import QUERIES

DOCS = [(k, f"{k} " + "word " * (100 if k % 2 else 1), ("en", "EN", "fr", "de", "es")[k * 7 % 5] if k % 9000 else "bg", f"s{k * 5 % 3}") for k in range(0, 20000, 37)]
DOCS += [(30001, None, "en", "s0"), (30002, "", "en", "s0"), (30003, "x", None, "s0"), (30004, "x", "en", None), (30005, "only", "fr", "t"), (30006, "two", "en", "u"), (30007, "deux", "fr", "u")]


@pytest.mark.parametrize("name", ["expand_multilingual_whole", "first_pair_whole"])
def test_every_document_goes_whole_into_an_entry(spark, tmp_path, name):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(path)
    got = sorted(tuple(x) for x in QUERIES[name](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        assert got == sorted(db.execute(ORACLES[name]).fetchall())
    assert len({x[0] for x in got}) == len(got)
    texts = {t for x in got for t in x[4:]}
    if name == "expand_multilingual_whole":
        assert texts - {""} == {t for _, t, lang, source in DOCS if t and lang and source}
    assert max(map(len, texts)) > 200 and ("EN", "FR", "", "only") in {x[2:] for x in got} and ("EN", "FR", "two", "deux") in {x[2:] for x in got}
