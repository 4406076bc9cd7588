"""The store of seen keys against a plain set of all keys."""

from __future__ import annotations

import random
import re

import pytest

from syndica.streaming import ingest, seen
from syndica.sources import pages as page_source


def _rows(spark, keys):
    return spark.createDataFrame([(f"f{k % 3}", str(k)) for k in keys], "feed_key string, guid string")


def _guids(df):
    return sorted(int(r.guid) for r in df.collect())


def test_batches_equal_a_set(spark, tmp_path):
    path, rng = str(tmp_path / "keys"), random.Random(1)
    before, batches = set(), []
    for n in range(9):
        batch = sorted(rng.sample(range(300), 60)) + ([1000 + n] if n else [])
        if n and n % 3 == 0:
            seen.compact(spark, path, n, keys_per_bucket=8)  # more buckets as the keys grow
        fresh = _guids(seen.unseen(spark, path, _rows(spark, batch), n))
        assert fresh == sorted(set(batch) - before)
        seen.record(spark, path, _rows(spark, fresh), n)
        batches.append((batch, fresh))
        before |= set(batch)
    manifest = seen.read_manifest(spark, path)
    assert manifest.buckets > seen.BUCKETS and manifest.through == 5
    assert sum(n for _, n in manifest.held.values()) == len({k for b, _ in batches[:6] for k in b})
    # batches that are run again, before and after the last compaction, give the same rows
    for n in (8, 7, 4, 0):
        assert _guids(seen.unseen(spark, path, _rows(spark, batches[n][0]), n)) == batches[n][1]
        seen.record(spark, path, _rows(spark, batches[n][1]), n)
    seen.compact(spark, path, 9, keys_per_bucket=8)
    assert _guids(seen.unseen(spark, path, _rows(spark, range(1_500)), 9)) == sorted(set(range(1_500)) - before)


def test_a_batch_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path):
    path = str(tmp_path / "keys")
    seen.record(spark, path, _rows(spark, range(2_000)), 0)
    seen.compact(spark, path, 1, keys_per_bucket=64)
    manifest = seen.read_manifest(spark, path)
    assert manifest.buckets == 32

    def read(keys):
        files = seen.known_keys(spark, path, _rows(spark, keys), 1).inputFiles()
        return {int(re.search(r"bucket=(\d+)", f)[1]) for f in files if "/base/" in f}

    assert read(range(5_000, 5_020)) == set()  # all new: filters suffice
    [own] = read([7])
    assert len(read([7, *range(6_000, 6_010)])) <= 2 and own in read([7, 6_001])
    # compaction leaves the buckets alone that no batch touched
    seen.record(spark, path, _rows(spark, [9_999]), 1)
    seen.compact(spark, path, 2, keys_per_bucket=64)
    gens = [g for g, _ in seen.read_manifest(spark, path).held.values()]
    assert sorted(gens) == [0] * 31 + [1]


def test_what_nothing_names_is_dropped(spark, tmp_path):
    path = tmp_path / "keys"
    for n in range(6):
        seen.record(spark, str(path), _rows(spark, range(100 * n, 100 * n + 90)), n)
        seen.compact(spark, str(path), n + 1)
    assert {p.name for p in (path / "base").iterdir() if p.name != "_SUCCESS"} == {"gen=4", "gen=5"}
    assert {p.name for p in (path / "delta").iterdir()} == {"batch_id=5"}
    assert _guids(seen.unseen(spark, str(path), _rows(spark, range(1_000)), 6)) == [
        k for k in range(1_000) if k % 100 >= 90 or k >= 600]


def test_small_buckets_share_folders(spark, tmp_path):
    """The number of folders does not follow that of the buckets."""
    path = tmp_path / "keys"
    seen.record(spark, str(path), _rows(spark, range(3_000)), 0)
    seen.compact(spark, str(path), 1, keys_per_bucket=8)
    assert seen.read_manifest(spark, str(path)).buckets == 512
    for kind in ("base", "bloom"):
        assert len(list(path.glob(f"{kind}/gen=0/bucket=*"))) == seen.FOLDERS
    assert _guids(seen.unseen(spark, str(path), _rows(spark, range(2_900, 3_100)), 1)) == list(range(3_000, 3_100))


def test_a_batch_recorded_before_buckets_were_split(spark, tmp_path):
    path = str(tmp_path / "keys")
    seen.record(spark, path, _rows(spark, range(500)), 0)
    seen.record(spark, path, _rows(spark, range(5_000, 5_050)), 1)
    seen.compact(spark, path, 1, keys_per_bucket=8)
    assert _guids(seen.unseen(spark, path, _rows(spark, range(5_000, 5_060)), 2)) == list(range(5_050, 5_060))


@pytest.mark.parametrize("every", [2, 16])
def test_ingest_over_many_batches(spark, tmp_path, pages, every):
    from syndica.plans.links import extract_links

    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")

    def land(*hrefs):
        html = "".join(f"<a href='/{h}'>title {h}</a>" for h in hrefs)
        pages(("http://h.example/", html)).coalesce(1).write.mode("append").parquet(landed)

    def run():
        ingest.start_item_ingest(page_source.stream_pages(spark, landed), extract_links, out,
                                 str(tmp_path / "checkpoint"), compact_every=every).awaitTermination()
        return sorted((r.guid[-1], r.batch_id) for r in ingest.read_published(spark, out).collect())

    want = []
    for n, hrefs in enumerate(("ab", "bc", "abcd", "a", "ef")):
        land(*hrefs)
        want += [(h, n) for h in hrefs if h not in {w for w, _ in want}]
        assert run() == sorted(want)


def test_a_table_without_a_store_gets_one(spark, tmp_path):
    path = str(tmp_path / "keys")
    published = _rows(spark, range(50)).selectExpr("*", "cast(int(guid) % 4 AS bigint) AS batch_id")
    seen.seed(spark, path, published)
    assert _guids(seen.unseen(spark, path, _rows(spark, range(40, 60)), 4)) == list(range(50, 60))
    assert _guids(seen.unseen(spark, path, _rows(spark, range(4)), 2)) == [2, 3]
