"""Streams in batches that a lost run goes on with, and large groups."""

import pytest

from quillstone.llm import exact_dedup
from tests.llm.test_operators import brute_groups


def found(rows):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}


def test_a_lost_run_goes_on_with_its_batch(spark, tmp_path, monkeypatch):
    path, home = str(tmp_path / "documents.parquet"), str(tmp_path / "home")
    for k in range(5):
        spark.createDataFrame([(3 * k + i, t) for i, t in enumerate(["a", "B" * k, "b"])], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    written, runs = exact_dedup._written, []

    def failing(folder):
        write = written(folder)

        def once(df, n):
            runs.append(n)
            if n == 2 and runs.count(2) == 1:
                raise RuntimeError("lost")
            write(df, n)

        return once

    monkeypatch.setattr(exact_dedup, "_written", failing)
    with pytest.raises(Exception, match="lost"):
        exact_dedup.deduplicate(spark, path, home, files_per_batch=1)
    got = found(exact_dedup.deduplicate(spark, path, home, files_per_batch=1).collect())
    assert runs[:4] == [0, 1, 2, 2] and runs.count(0) == 1  # finished batches are not run again
    texts = {3 * k + i: t.lower() for k in range(5) for i, t in enumerate(["a", "B" * k, "b"])}
    same = {i: [j for j in texts if texts[j] == texts[i]] for i in texts}
    assert got == {i: (max(same[i]), len(same[i]), max(same[i]) == i) for i in texts}


@pytest.mark.parametrize("digest_bytes", [32, 0])
def test_a_group_of_many_copies_is_dealt_to_several_tasks(spark, tmp_path, monkeypatch, digest_bytes):
    monkeypatch.setattr(exact_dedup, "HIT_ROWS", 8)
    rows = [(i, "Same" if i % 3 else "same") for i in range(100)] + [(100 + i, f"no{i:02d}") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path := str(tmp_path / "documents.parquet"))
    got = exact_dedup.deduplicate(spark, path, digest_bytes=digest_bytes).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute_groups(rows))


def test_a_file_or_a_folder_of_its_name(spark, tmp_path):
    file, folder = tmp_path / "a b.parquet", tmp_path / "c.parquet"
    spark.createDataFrame([(1, "x")], "doc_id long, text string").toPandas().to_parquet(file)
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(str(folder))
    assert list(exact_dedup._folder(spark, str(file))) == [str(tmp_path), "a b.parquet"]
    assert exact_dedup._folder(spark, f"{folder}/") == (f"{folder}/", None)
