"""The pipeline's stages over odd tables, the guard of the entry file, and the registered queries."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, `__id` int"


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")}
    assert "pipeline" in names
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mix", "pack"]


def odd_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
    base = " ".join(f"t{i}" for i in range(120))
    rows = [(i, f"plain text number {i} " + " ".join(f"u{i}v{j}" for j in range(30)), "en", "s0", 1, "clash", 7) for i in range(40)]
    rows += [(100, base, "en", "s1", 1, None, None), (101, base, None, None, None, None, None),
             (102, base.replace("t60", "q"), "de", "s1", 1, None, None), (103, None, None, None, None, None, None),
             (104, "", "en", "s0", 0, None, None), (105, long, "en", "s0", 1, None, None),
             (106, "mail me at joe.doe@mail.example.com now", "en", "s0", 1, None, None),
             (None, None, None, None, None, None, None)]
    return rows


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    deduped = stages["near_dedup"](spark, docs, SF)
    ids = {r[0] for r in deduped.select("doc_id").collect()}
    assert deduped.columns == docs.columns and deduped.schema == docs.schema
    assert ids == {r[0] for r in odd_rows()} - {101, 102}
    private = stages["pii"](spark, docs, SF)
    text = {r["doc_id"]: r for r in private.collect()}
    assert private.columns == docs.columns and len(text) == len(odd_rows())
    assert text[106]["text"] == "mail me at [EMAIL] now" and text[106]["n_chars"] == 22 and text[103]["text"] is None
    mixed = stages["mix"](spark, docs, SF)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= len(odd_rows())
    packed = stages["pack"](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == len(odd_rows())
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_near_dedup_keeps_one_row_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (3, b), (None, c), (None, c), (None, a), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted([(5, a), (3, b), (0, c), (8, ""), (8, "")])


def test_pipeline_on_the_small_table(spark):
    out = corpus_pipeline.run(spark, SF)
    total = out.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total[0] > 0 and total[1] <= 1.1 * -(-total[0] // 2048) + 1
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.join(whole, "doc_id", "left_anti").count() == 0


@pytest.mark.parametrize("name", ["op1_chat_formatting", "op5_mix_to_targets"])
def test_sql_parity(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)

    def plain(rows):
        return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(map(tuple, df.select(*names).collect())) == plain(cur.fetchall())
