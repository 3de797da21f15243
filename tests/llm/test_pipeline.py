import random
import shutil

from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm.common import BYTES_PER_BATCH, ROWS_PER_READ, table


def test_pipeline_on_small_tables(spark, documents, labels, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(("an", "ti", "lo", "re", "mu", "so", "ka")) for _ in range(3))
    line = lambda n: " ".join(word() for _ in range(n))
    item = line(30)
    rows = [(k, f"{line(60)}\nthe menu of this site\n{line(20)}", f"s{k % 2}") for k in range(300)]
    toxic = [(1000 + k, f"{line(20)} zgrob{word()} {line(10)} zgrob{word()}", "s0") for k in range(120)]
    copies = [(2000, rows[0][1] + " end", "s0"), (2001, rows[0][1], "s1")]
    leaks = [(3000, f"{line(40)}\n{item}\n{line(5)}", "s0")]
    odd = [(None, line(50), "s0"), (None, line(50), "s1"), (None, rows[2][1], "s0"), (5, f"another text of an id {line(40)}", "s1"), (4000, None, "s0"), (4001, "", "s1"), (6000, line(20_000), "s0")]
    docs = documents(*rows, *toxic, *copies, *leaks, *odd)
    for name in ("sig", "key", "hash", "comp", "score", "cell", "n", "item", "lines"):  # names that the stages use themselves
        docs = docs.withColumn(name, F.lit(7))
    d = tmp_path / "data"
    docs.write.parquet(str(d / "documents.parquet"))
    labels(*[(r[0], 1, 0) for r in rows], *[(r[0], 1, 1) for r in toxic], (None, 1, 1), (1, None, None)).write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    now = spark.read.parquet(str(d / "documents.parquet"))
    kept, unnamed = [], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(d))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        found = now.collect()
        kept.append({r.doc_id: r for r in found if r.doc_id is not None})
        unnamed.append(sum(r.doc_id is None for r in found))
        assert sum(r.doc_id == 5 for r in found) == 2  # another text of an id is another document
    tox, lines, near, clean = kept
    assert not set(tox) & {r[0] for r in toxic} and {r[0] for r in rows} <= set(tox)
    assert set(lines) == set(tox) and not any("menu" in (r.text or "") for r in lines.values()) and lines[5].n_chars == len(lines[5].text)
    assert set(lines) - set(near) == {2000, 2001} and set(near) - set(clean) == {3000}
    assert unnamed == [3, 3, 2, 2]  # the copy of a document goes
    packed = {r.doc_id for r in corpus_pipeline.run(spark, str(d)).collect()}
    assert packed == set(clean) | {None}
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(d)).count() == 0
    shutil.rmtree(tmp_path / "data")


def test_tables_are_read_in_bounded_batches(spark, labels, tmp_path):
    labels((1, 1, 0)).write.parquet(str(tmp_path / "labels.parquet"))
    session = spark.newSession()
    read, sent = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    assert table(session, str(tmp_path), "labels").count() == 1
    assert int(session.conf.get(read)) == ROWS_PER_READ and int(session.conf.get(sent)) == BYTES_PER_BATCH
    session.conf.set(read, "100")  # what the session asks for already is less
    assert table(session, str(tmp_path), "labels").count() == 1 and session.conf.get(read) == "100"
