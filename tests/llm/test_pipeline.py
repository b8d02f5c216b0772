"""The pipeline's stages on a small table, each against brute force over its own input."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from hopframe.llm import queries, secrets
from tests.llm.test_neardup import _roots, _shingles

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.first()
    odd = [(10**6, None, "en", "src0", 0), (10**6 + 1, "12 345 !", "en", "src0", 8), (10**6 + 2, "", None, None, 0), (10**6 + 3, base.text, base.lang, base.source, base.n_chars), (base.doc_id, base.text, base.lang, base.source, base.n_chars)]
    secret = 'The and of to it was there token = "' + "0123456789abcdef" * 2 + 'deadbeef" and by the of.'
    odd.append((10**6 + 4, secret, "en", "src1", len(secret)))
    now = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "n_chars as kept", "1 as score", "2 as lang_pred", "3 as mix_size", "4 as key", "5 as shard", "6 as c0", "7 as f")
    columns = now.columns
    seen = [now.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(now.collect())
    first, spoken, unique, clean, mixed, encoded = seen

    lost = {r.doc_id for r in first} - {r.doc_id for r in spoken}
    assert {10**6, 10**6 + 1, 10**6 + 2} <= lost and len(lost) <= 5
    right = [r.lang == {x.doc_id: x.lang for x in first}[r.doc_id] for r in spoken]
    assert np.mean(right) > 0.97

    sets = {r.doc_id: _shingles(r.text, 5) for r in spoken}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(sets, links)
    assert sorted(r.doc_id for r in unique) == sorted(set(roots.values()))

    texts = {r.doc_id: r.text for r in unique}
    token = re.compile(r'token = "[0-9a-f]{40}"')
    assert sorted(r.doc_id for r in clean) == sorted(texts)
    for r in clean:
        assert not token.search(r.text) and r.n_chars == len(r.text)
        if not token.search(texts[r.doc_id]) and "AKIA" not in texts[r.doc_id] and "password" not in texts[r.doc_id]:
            assert r.text == texts[r.doc_id]
    assert [secrets.MASK in r.text for r in clean if r.doc_id == 10**6 + 4] == [True]

    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert abs(words(mixed) / words(clean) - 1.5) < 0.1
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and len(mixed) > len(set(r.doc_id for r in mixed))

    library = Tokenizer.from_file(queries.tokenizer_file())
    by_id = {r.doc_id: r.text for r in mixed}
    assert len(encoded) == len(mixed)
    for r in encoded:
        assert r.ids == library.encode(by_id[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows_of_one_id_keep_their_texts(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, words(1), "a"), (1, words(2), "b"), (1, words(1), "c"), (2, words(1), "d"), (3, words(3), "e"), (None, words(3), "f"), (4, None, "g"), (4, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((r.doc_id or 0, r.text or "", r.row) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert [x[:2] for x in got] == [(0, words(3)), (1, words(1)), (1, words(2)), (3, words(3)), (4, "")]
    again = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), SF).collect()
    assert got == sorted((r.doc_id or 0, r.text or "", r.row) for r in again)


def test_run_and_entry(spark):
    import __spark_entry__

    assert [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n) or n == "pipeline"] == [*queries.queries(), "pipeline"]
    out = __spark_entry__.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 100


def test_registered_sql(spark, tmp_path):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in queries.oracle_sql().items():
        queries.queries()[name](spark, SF).write.parquet(str(tmp_path / name))
        con.execute(f"CREATE OR REPLACE TABLE got AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        con.execute(f"CREATE OR REPLACE TABLE want AS {sql}")
        columns = ", ".join(sorted(r[0] for r in con.execute("DESCRIBE want").fetchall()))
        for a, b in (("got", "want"), ("want", "got")):
            assert con.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == [], name
