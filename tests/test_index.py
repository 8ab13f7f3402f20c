"""Discovery, snapshots and whole index runs on folders."""

import json
import os
import threading
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import cli
from lectern import config as settings
from lectern.operators import documents, graph, search
from lectern.operators.embedding import HashingEmbedder
from lectern.plans import corpus, indexer
from lectern.sources import discovery, store
from lectern.streaming import reindex


class Broken:
    def embed(self, texts):
        raise RuntimeError("no embeddings")


class Short:
    def embed(self, texts):
        return [[0.0] * 8] * (len(texts) - 1)


@pytest.fixture
def config(tmp_path):
    data = tmp_path / "data"
    (data / "sub/.hidden").mkdir(parents=True)
    (data / "a.md").write_text("---\ntitle: A\ndomain: eng\ntags: [x, y]\nfile_path: liar\n---\n# A\nalpha beta")
    (data / "sub/b.md").write_text("---\ntitle: B\n---\n# B\ngamma delta")
    (data / "sub/.hidden/_c.md").write_text("# C\nepsilon")
    (data / "README.md").write_text("no")
    (data / "other.txt").write_text("no")
    (data / "bad.md").write_bytes(b"\xff\xfe")
    (data / "link.md").symlink_to(data / "a.md")
    (data / "loop").symlink_to(data)
    c = settings.Config(source=settings.Source(data_path=str(data)), frontmatter=settings.Frontmatter(indexed_fields=("domain", "tags")), embedding=settings.Embedding("hashing:", "m", vector_size=8), qdrant=settings.Qdrant(f"file://{tmp_path}/store", "kb"))
    return c


def test_discovery(spark, config):
    found = [r[0] for r in discovery.discover(spark, config.source.data_path, config.indexing).collect()]
    assert found == ["a.md", "bad.md", "sub/.hidden/_c.md", "sub/b.md"]
    read = discovery.read(spark.createDataFrame([(p,) for p in found] + [("gone.md",)], "file_path string"), config.source.data_path)
    assert sorted(r["file_path"] for r in read.collect()) == ["a.md", "sub/.hidden/_c.md", "sub/b.md"]
    with pytest.raises(FileNotFoundError):
        discovery.discover(spark, "/no/such/folder")


def test_incremental_runs(spark, config, tmp_path):
    data, e = tmp_path / "data", HashingEmbedder(8)
    col = store.Collection(spark, config.qdrant.url, "kb")
    assert col.count() is None
    s = indexer.run_index(spark, config, e)
    assert (s.discovered, s.indexed, s.skipped, s.orphans, col.count()) == (4, 3, 0, 0, 3)
    a = col.points().where("file_path = 'a.md'").first()
    payload = json.loads(a["payload"])
    assert payload["file_path"] == "a.md" and payload["title"] == "A" and payload["tags"] == ["x", "y"] and payload["text"] == "# A\nalpha beta" and a["slist_tags"] == ["x", "y"] and a["s_domain"] == "eng" and "i_domain" not in a
    assert indexer.run_index(spark, config, e).skipped == 3
    (data / "a.md").write_text("# A\nchanged")
    (data / "sub/b.md").unlink()
    s = indexer.run_index(spark, config, e)
    assert (s.indexed, s.skipped, s.orphans) == (1, 1, 1)
    assert {r["file_path"]: r["text"] for r in col.points().collect()} == {"a.md": "# A\nchanged", "sub/.hidden/_c.md": "# C\nepsilon"}
    assert [r["file_path"] for r in col.state().orderBy("file_path").collect()] == ["a.md", "sub/.hidden/_c.md"]
    (data / "a.md").write_text("   \n")  # empty now: old points and state stay
    indexer.run_index(spark, config, e)
    assert col.points().where("text = '# A\nchanged'").count() == 1
    assert indexer.run_index(spark, config, e, full=True).indexed == 1 and col.count() == 1
    col.drop()
    assert col.count() is None


@pytest.mark.parametrize("embedder, message", [(Broken(), "no embeddings"), (Short(), "count mismatch")])
def test_a_failed_run_leaves_the_old_snapshot(spark, config, tmp_path, embedder, message):
    col = store.Collection(spark, config.qdrant.url, "kb")
    indexer.run_index(spark, config, HashingEmbedder(8))
    before = sorted(r["id"] for r in col.points().collect())
    (tmp_path / "data/a.md").write_text("# new")
    with pytest.raises(Exception, match=message):
        indexer.run_index(spark, config, embedder, full=True)
    assert sorted(r["id"] for r in col.points().collect()) == before and col.state().count() == 3
    assert indexer.run_index(spark, config, HashingEmbedder(8)).indexed == 1


def test_strict_validation_aborts(spark, config):
    strict = replace(config, frontmatter=replace(config.frontmatter, required=("title",)), validation=settings.Validation(strict=True))
    with pytest.raises(indexer.ValidationFailed, match="1 invalid files, sub/.hidden/_c.md"):
        indexer.run_index(spark, strict, HashingEmbedder(8))
    loose = replace(strict, validation=settings.Validation())
    s = indexer.run_index(spark, loose, HashingEmbedder(8))
    assert (s.indexed, s.invalid) == (2, 1)
    lines = []
    assert cli.validate(spark, strict, lines.append) == 1 and cli.validate(spark, loose, lines.append) == 0
    assert lines[-1] == "2 valid, 2 invalid"
    off = replace(strict, validation=settings.Validation(enabled=False, strict=True))
    assert indexer.run_index(spark, off, HashingEmbedder(8), full=True).indexed == 3


def test_a_later_run_reads_files_once_and_checks_the_changed_ones_only(spark, config, tmp_path):
    indexer.run_index(spark, config, HashingEmbedder(8))
    (tmp_path / "data/a.md").write_text("---\ntitle: A2\n---\n# A\nchanged")
    linted = tmp_path / "linted"
    linting = replace(config, validation=settings.Validation(lint_command=("sh", "-c", f'echo "$1" >> {linted}', "--")))
    root = config.source.data_path
    found, state = discovery.discover(spark, root, config.indexing), store.Collection(spark, config.qdrant.url, "kb").state()
    planned = indexer.plan(found, state, config, root=root)
    steps = planned._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("MapInArrow") == 1 and steps.index("MapInArrow") < steps.index("Join")  # read after the join, by one step
    assert planned.rdd.getNumPartitions() == 4  # dealt out by number, however few bytes the paths have
    got = {r["file_path"]: r.asDict() for r in indexer.plan(found, state, linting, root=root).collect()}
    assert {p: (r["outcome"], r["was_indexed"], len(r["chunks"]), r["fields"]) for p, r in got.items()} == {
        "a.md": ("ready", True, 1, {"title": '"A2"'}), "sub/b.md": ("skipped", True, 0, {}), "sub/.hidden/_c.md": ("skipped", True, 0, {})
    }
    assert linted.read_text().splitlines() == [f"{root}/a.md"]


def test_links_are_put_by_two_tasks_at_a_time(spark, tmp_path):
    root = f"file://{tmp_path}/tree"
    corpus.write_tree(spark.createDataFrame([("d/a.md", "x", False)], "path string, body string, link boolean"), root)
    corpus.write_tree(spark.createDataFrame([("d/a.md", "x", True)] * 4000, "path string, body string, link boolean").repartition(4), root)
    assert [p.name for p in (tmp_path / "tree/d").iterdir()] == ["a.md"] and (tmp_path / "tree/d/a.md").is_symlink()


def test_a_lock_that_is_being_renewed_is_not_lost(spark, tmp_path, monkeypatch):
    col, files = store.Collection(spark, f"file://{tmp_path}/s", "c"), Files(spark)
    col.ensure(1, ["n"])
    read, empty = col.versions._read, [True]
    monkeypatch.setattr(col.versions, "_read", lambda p: "" if p.endswith("LOCK") and empty and empty.pop() else read(p))
    with col.writing():
        files.update(col, ["a.md"], "one")
    assert not empty and col.count() == 1 and not (tmp_path / "s/c/LOCK").exists()


def test_store_rules(spark, tmp_path):
    col = store.Collection(spark, f"file://{tmp_path}/s", "c")
    with pytest.raises(store.StoreError):
        col.points()
    col.ensure(4, ["tags", "file_path"])
    col.ensure(4, ["tags", "file_path"])
    with pytest.raises(store.StoreError, match="vectors of 4"):
        col.ensure(5, [])
    with col.writing(), pytest.raises(store.StoreError, match="another run"), col.writing(wait=0.2):
        pass
    points = spark.createDataFrame([("1", [1.0] * 4, "{}", "a.md", 0, "t", 1, 2, None, None, None, ["x"], None, None)], store.points_schema(["tags", "file_path"]))
    state = store.upsert_state(col.state(), spark.createDataFrame([("a.md", "h", 1)], "file_path string, content_hash string, chunk_count bigint"))
    for version in (1, 2, 3):
        assert col.commit(points, state) == version
    assert col.count() == 1 and col.state_of("a.md")["content_hash"] == "h" and col.state_of("b.md") is None
    none = spark.createDataFrame([], "file_path string")
    assert store.delete_by_files(col.points(), none).count() == 1
    assert col.points().columns[-1] == "slist_tags" and search.where_all(col.points(), {"tags": "x"}).count() == 1
    col.clear()
    assert col.count() == 0 and col.state().count() == 0


class Files:
    """Points and state of files, one point each, for a collection with the indexed field n (the length of the name, and a list)."""

    def __init__(self, spark):
        self.spark = spark

    def points(self, paths, text):
        return self.spark.createDataFrame([(f"{p}#{text}", [1.0], "{}", p, 0, text, 1, 1, None, len(p), None, [text, p, text], None, None) for p in paths], store.points_schema(["n"]))

    def state(self, paths):
        return self.spark.createDataFrame([(p, "h", 1) for p in paths], "file_path string, content_hash string, chunk_count bigint")

    def gone(self, paths):
        return self.spark.createDataFrame([(p,) for p in paths], "file_path string")

    def update(self, col, paths, text, gone=()):
        return col.apply(self.points(paths, text), self.gone(gone), self.state(paths))


@pytest.mark.parametrize("lookup", [store.LOOKUP, 1])
def test_updates_write_what_they_change(spark, tmp_path, monkeypatch, lookup):
    monkeypatch.setattr(store, "LOOKUP", lookup)
    col, files = store.Collection(spark, f"file://{tmp_path}/s", "c"), Files(spark)
    col.ensure(1, ["n"])
    names = [f"{i}.md" for i in range(40)]
    rows, state, gone = files.points, files.state, files.gone
    col.apply(rows(names, "old"), gone([]), state(names))
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "s/c/points").rglob("part-*")}
    col.apply(rows(["3.md", "new.md"], "new"), gone(["5.md"]), state(["3.md", "new.md"]))
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "s/c/points").rglob("part-*")}
    assert before.items() <= after.items()  # no old file is written again
    table = col.versions.latest()["points"]
    assert sorted((s["rows"], s["dead"]) for s in table["segments"]) == [(2, 0), (40, 2)] and len(table["deletes"]) == 1
    got = {(r["file_path"], r["text"]) for r in col.points().collect()}
    assert got == {(p, "old") for p in names if p not in ("3.md", "5.md")} | {("3.md", "new"), ("new.md", "new")}
    assert col.count() == 40 and col.state().count() == 40 and col.state_of("5.md") is None and col.state_of("new.md")["chunk_count"] == 1
    col.apply(rows([], ""), gone(["7.md", "new.md"]), state([]))
    assert col.count() == 38 and {(r["value"], r["count"]) for r in col.facet("n", 3).collect()} == {("old", 37), ("0.md", 1), ("1.md", 1)}
    want = sorted((r["file_path"], r["text"]) for r in col.points().collect())
    assert col.compact(full=True) and sorted((r["file_path"], r["text"]) for r in col.points().collect()) == want
    table = col.versions.latest()["points"]
    assert [(s["rows"], s["dead"]) for s in table["segments"]] == [(38, 0)] and not table["deletes"] and not col.compact()
    assert {(r["value"], r["count"]) for r in col.facet("n", 3).collect()} == {("old", 37), ("0.md", 1), ("1.md", 1)}
    files.update(col, ["9.md"], "again")
    kept = {x for k in ("points", "state") for t in (col.versions.latest()[k],) for part in ("segments", "deletes") for x in [y["id"] for y in t[part]]}
    assert {f"points/{p.name}" for p in (tmp_path / "s/c/points").iterdir()} == {x for x in kept if x.startswith("points/")}  # two versions old ones are gone
    col.apply(rows(["only.md"], "x"), gone([]), state(["only.md"]), full=True)
    assert [r["file_path"] for r in col.points().collect()] == ["only.md"] and col.state().count() == 1
    assert search.where_all(col.points(), {"n": 7}).count() == 1 and search.where_all(col.points(), {"n": "7"}).count() == 0


def test_many_updates_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MERGE", 3)
    col, files = store.Collection(spark, f"file://{tmp_path}/s", "c"), Files(spark)
    col.ensure(1, ["n"])
    have = {}
    for k in range(7):
        paths = [f"{(3 * k + j) % 11}.md" for j in range(3)]
        files.update(col, paths, f"t{k}", gone=[f"{(5 * k) % 11}.md"])
        have = {p: t for p, t in have.items() if p != f"{(5 * k) % 11}.md"} | {p: f"t{k}" for p in paths}
        assert {r["file_path"]: r["text"] for r in col.points().collect()} == have and col.count() == len(have)
        counts = {t: list(have.values()).count(t) for t in have.values()} | {p: 1 for p in have}
        assert {r["value"]: r["count"] for r in col.facet("n", 50).collect()} == counts
    assert len(col.versions.latest()["points"]["segments"]) <= 5


def test_filters_read_the_files_that_hold_them(spark, tmp_path):
    col, files = store.Collection(spark, f"file://{tmp_path}/s", "c"), Files(spark)
    col.ensure(1, ["n"])
    for k in range(5):
        files.update(col, [f"{'x' * k}{j}.md" for j in range(3)], f"t{k}", gone=["xx1.md"] if k == 4 else [])
    all_files = len(col.points().inputFiles())
    for filters, rows, few in (({"n": 6}, 2, 1), ({"n": "t3"}, 3, 1), ({"n": ["t0", "xxx2.md"]}, 4, 2), ({"n": "none"}, 0, 0), ({"n": "xx1.md"}, 0, 0), ({"n": True}, 0, 0), ({"n": []}, 0, 0), ({"other": 1}, 0, 5)):
        found = search.where_all(col.points(filters), filters)
        assert found.count() == rows and len(col.points(filters).inputFiles()) == few <= all_files == 5, filters


def exact_top(rows, query, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(np.array(v, float))
    return [i for _, i in sorted((-float(unit(v) @ unit(query)), i) for i, v in rows)[:k]]


def test_graph_search_finds_what_a_scan_finds(spark):
    """Recall on clustered vectors over several blocks, all queries against all points; filters are respected."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24)) * 2
    vectors = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24))).astype(np.float32)
    rows = [(f"p{k:04d}", v.tolist(), f"d{k % 3}", f"rare{k % 500}") for k, v in enumerate(vectors)] + [("null", None, "d0", "x"), ("zero", [0.0] * 24, "d0", "x")]
    points = spark.createDataFrame(rows, "id string, vector array<float>, domain string, tag string").cache()
    built = graph.build(points, block=2000).cache()
    assert built.count() == 4 and sum(len(r["ids"]) for r in built.select("ids").collect()) == 6000
    hit = 0
    for filters, chosen in ((None, rows[:6000]), ({"domain": "d1"}, [r for r in rows[:6000] if r[2] == "d1"]), ({"tag": "rare7"}, [r for r in rows if r[3] == "rare7"])):
        for q in rng.choice(6000, 7, replace=False):
            query = vectors[q] + 0.3 * rng.normal(size=24)
            allowed = None if filters is None else search.where_all(points, filters).select("id")
            got = [r["id"] for r in graph.search(built, query.tolist(), 10, allowed).orderBy(F.desc("score"), "id").limit(10).collect()]
            want = exact_top([(r[0], r[1]) for r in chosen], query, 10)
            assert set(got) <= {r[0] for r in chosen} and (filters != {"tag": "rare7"} or got == want)
            hit += len(set(got) & set(want))
    assert hit >= 0.95 * 210
    few = graph.top_k(built, points, vectors[0].tolist(), 14, {"tag": "rare7"})  # more than there are
    assert few.count() == 12 and graph.search(built, [0.0] * 24, 3).isEmpty() and graph.search(built, [1.0], 3).isEmpty()


def test_linking_a_block_takes_bounded_memory():
    import tracemalloc

    vectors = np.random.default_rng(6).normal(size=(6000, 24)).astype(np.float32)
    tracemalloc.start()
    links, _ = graph.linked(vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links.shape == (6000, 32) and peak < 120 << 20


def test_a_collection_searches_by_its_graph(spark, tmp_path):
    rng = np.random.default_rng(5)
    col = store.Collection(spark, f"file://{tmp_path}/s", "c")
    col.ensure(8, ["domain"])
    vectors = {f"{k}.md": rng.normal(size=8).astype(np.float32).tolist() for k in range(300)}

    def rows(paths):
        return spark.createDataFrame([(f"id-{p}", vectors[p], "{}", p, 0, p, 1, 1, f"d{len(p)}", None, None, None, None, None) for p in paths], store.points_schema(["domain"]))

    files = Files(spark)
    col.apply(rows(vectors), files.gone([]), files.state(vectors))
    assert not col.build_graph(1.0) and col.build_graph(0.2) and not col.build_graph(0.2)
    query = rng.normal(size=8).tolist()
    top = lambda k, f=None: [r["text"] for r in col.nearest(query, k, f).orderBy("rank").collect()]
    assert top(10) == exact_top(vectors.items(), query, 10) and top(0) == []
    assert top(5, {"domain": "d4"}) == exact_top([x for x in vectors.items() if len(x[0]) == 4], query, 5)
    best = top(3)
    vectors[best[0]] = [-x for x in query]  # moved to the far end
    vectors["new.md"] = query
    col.apply(rows([best[0], "new.md"]), files.gone([best[1]]), files.state([best[0], "new.md"]))
    del vectors[best[1]]
    assert top(8) == exact_top(vectors.items(), query, 8) and top(8)[0] == "new.md"
    assert len(top(300)) == 300 and "vector" not in col.nearest(query, 3).columns
    folders = len(list((tmp_path / "s/c/graph").iterdir()))
    assert col.build_graph(0.0) and top(8) == exact_top(vectors.items(), query, 8) and folders == 1


def test_a_writer_that_has_lost_the_lock_changes_nothing(spark, tmp_path):
    col, files = store.Collection(spark, f"file://{tmp_path}/s", "c"), Files(spark)
    col.ensure(1, ["n"])
    files.update(col, ["a.md"], "one")
    lock, other = tmp_path / "s/c/LOCK", store.Collection(spark, f"file://{tmp_path}/s", "c")
    seen = []
    with pytest.raises(store.StoreError, match="gone to another run"), col.writing():
        os.utime(lock, (time.time() - 1000,) * 2)

        def second():
            with other.writing(wait=2):
                files.update(other, ["b.md"], "two")
                seen.append("in")
                ready.set()
                go.wait(60)
            seen.append("out")

        ready, go = threading.Event(), threading.Event()
        t = threading.Thread(target=second)
        t.start()
        assert ready.wait(60)
        files.update(col, ["c.md"], "late")
    assert seen == ["in"] and lock.exists()  # the first has not taken the second's lock away
    with pytest.raises(store.StoreError, match="another run"), col.writing(wait=0.2):
        pass
    go.set()
    t.join()
    assert not lock.exists() and sorted(r["file_path"] for r in col.points().collect()) == ["a.md", "b.md"]
    assert len(list((tmp_path / "s/c/points").iterdir())) == 2  # what the late one wrote is gone


def test_writers_without_a_lock_follow_each_other(spark, tmp_path, monkeypatch):
    """A commit that another overtakes is made again on top of the newer version."""
    one, two = (store.Collection(spark, f"file://{tmp_path}/s", "c") for _ in range(2))
    files = Files(spark)
    one.ensure(1, ["n"])
    files.update(one, ["a.md", "b.md"], "old")
    put, first = one.versions.put, []

    def late(version):
        if not first:
            first.append(files.update(two, ["b.md", "c.md"], "two"))
        put(version)

    monkeypatch.setattr(one.versions, "put", late)
    assert files.update(one, ["a.md", "c.md"], "one") >= 3 and first == [2]
    assert {r["file_path"]: r["text"] for r in one.points().collect()} == {"a.md": "one", "b.md": "two", "c.md": "one"}
    assert {(r["value"], r["count"]) for r in one.facet("n", 2).collect()} == {("one", 2), ("a.md", 1)}
    stale = one.versions.latest() | {"version": 1}
    with pytest.raises(store.Conflict):
        two.versions.put(stale)
    (tmp_path / "s/c/log/00000000000000000000.json").unlink()
    (tmp_path / "s/c/log/00000000000000000001.json").unlink()
    with pytest.raises(store.Conflict, match="long ago"):
        two.versions.put(stale)
    assert two.versions.latest()["version"] >= 3


def test_scalar_filters_reach_the_scan(spark, config):
    indexer.run_index(spark, config, HashingEmbedder(8))
    points = store.Collection(spark, config.qdrant.url, "kb").points()
    plan = search.where_all(points, {"domain": "eng"}).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s_domain), EqualTo(s_domain,eng)]" in plan


def test_writers_wait_for_each_other(spark, tmp_path):
    col = store.Collection(spark, f"file://{tmp_path}/s", "c")
    col.ensure(1, [])
    done = []

    def first():
        with col.writing():
            time.sleep(0.5)
            done.append(1)

    t = threading.Thread(target=first)
    t.start()
    time.sleep(0.2)
    with col.writing():
        done.append(2)
    t.join()
    assert done == [1, 2]
    with col.writing():  # a writer that died an hour ago
        lock = tmp_path / "s/c/LOCK"
        os.utime(lock, (time.time() - 3600,) * 2)
        with col.writing(wait=1):
            pass


@pytest.fixture
def mounted(spark, tmp_path):
    """tmp_path under a URL that only the JVM opens."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.disk.link./m", f"file://{tmp_path}")
    return "viewfs://disk/m"


def test_the_same_files_by_folder_and_by_url(spark, config, tmp_path):
    for name in ("sub/it's.md", "sub/a b%20.md", "_x/.y/_z.md"):
        (tmp_path / "data" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / name).write_text(f"# {name}")
    (tmp_path / "data/sub/up").symlink_to(tmp_path / "data")
    want = sorted(["a.md", "bad.md", "sub/.hidden/_c.md", "sub/b.md", "sub/it's.md", "sub/a b%20.md", "_x/.y/_z.md"])
    for root in (f"{tmp_path}/data", f"file://{tmp_path}/data", f"file:{tmp_path}/data"):
        found = discovery.discover(spark, root, config.indexing)
        assert [r[0] for r in found.collect()] == want, root
        read = {r["file_path"]: r["content"] for r in discovery.load(spark, found, root).collect()}
        assert set(read) == set(want) - {"bad.md"} and read["_x/.y/_z.md"] == "# _x/.y/_z.md"


def test_stores_that_only_the_jvm_reads(spark, config, tmp_path, mounted, caplog):
    for link in ("link.md", "loop"):
        (tmp_path / "data" / link).unlink()
    root = f"{mounted}/data"
    found = discovery.discover(spark, root, config.indexing)
    assert [r[0] for r in found.collect()] == ["a.md", "bad.md", "sub/.hidden/_c.md", "sub/b.md"]
    with caplog.at_level("ERROR"):
        texts = {r["file_path"]: r["content"] for r in discovery.load(spark, found, root).collect()}
    assert texts["sub/.hidden/_c.md"] == "# C\nepsilon" and "bad.md" not in texts and "bad.md is not UTF-8" in caplog.text
    with pytest.raises(FileNotFoundError):
        discovery.discover(spark, f"{mounted}/no")
    by_url = replace(config, source=replace(config.source, data_path=root))
    assert indexer.run_index(spark, by_url, HashingEmbedder(8)).indexed == 3
    get = lambda p, at=root: documents.get_document(at, p, ["**/*.md"], spark)
    assert get("a.md").startswith("---") and get("./sub/../README.md") == "no" and get(f"{root}/sub/b.md").endswith("gamma delta")
    for path, message in (("no.md", "File not found"), ("../x.md", "outside"), ("a/../../x.md", "outside"), ("/etc/passwd", "outside"), ("file:///etc/passwd", "outside"), ("other.txt", "not permitted"), ("bad.md", "Failed to read")):
        with pytest.raises(documents.DocumentError, match=message):
            get(path)
    assert documents.get_document(f"file://{tmp_path}/data", "sub/b.md", ["**/*.md"]) == get("sub/b.md")


def test_folders_are_dealt_out_without_listing_files(tmp_path):
    for k in range(40):
        (tmp_path / f"d{k % 4}/e{k}").mkdir(parents=True)
        (tmp_path / f"d{k % 4}/e{k}/f.md").write_text("")
        (tmp_path / f"d{k % 4}/g{k}.md").write_text("")
    (tmp_path / "top.md").write_text("")
    tree = discovery.trees.LocalTree(str(tmp_path))
    for least in (1, 3, 20, 1000):
        parts = discovery.dealt(tree, least)
        assert least > 40 or sum(p.deep for p in parts) >= least
        paths = [x for p in parts for x in discovery.walk(tree, lambda _: True, p.path, p.deep)]
        assert len(paths) == len(set(paths)) == 81


def test_object_stores_are_listed_and_read_through_arrow(tmp_path):
    from pyarrow import fs

    (tmp_path / "kb/.d").mkdir(parents=True)
    (tmp_path / "kb/.d/_a.md").write_text("x")
    tree = discovery.trees.portable("s3a://bucket/kb")
    assert tree.url == "s3://bucket/kb"
    tree._fs = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "kb"  # what the URL would open
    assert list(discovery.walk(tree, lambda _: True)) == [".d/_a.md"] and tree.read(".d/_a.md") == b"x"
    assert tree.resolve("s3a://bucket/kb/.d/./_a.md") == ".d/_a.md" and tree.resolve("s3://bucket/other") is None and tree.resolve("../kb/x") is None
    with pytest.raises(FileNotFoundError):
        tree.resolve("no.md")


def test_search_and_status_commands(spark, config):
    indexer.run_index(spark, config, HashingEmbedder(8))
    from lectern.operators.search import SearchRequest

    text = cli.find(spark, config, SearchRequest("alpha beta", domain="eng", tags=["y", "z"]))
    assert text.startswith("## Result 1\n**Title**: A\n**Score**: ") and "**File**: a.md (lines 1–2)" in text and "**Tags**: x, y" in text
    assert cli.find(spark, config, SearchRequest("alpha", domain="none")) == "No results found."
    lines = []
    cli.status(spark, config, lines.append)
    assert lines[0] == "State: 3 indexed files" and lines[-1] == "Collection 'kb': 3 points"


def test_deliveries_trigger_one_run(spark, tmp_path):
    import hashlib
    import hmac as h

    body = '{"ref":"refs/heads/main"}'
    good = h.new(b"s", body.encode(), hashlib.sha256).hexdigest()
    spark.createDataFrame([(body, good), (body, good), (body, "bad")], "body string, signature string").coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []
    stream = spark.readStream.schema("body string, signature string").parquet(str(tmp_path / "in"))
    q = reindex.on_deliveries(stream, lambda: calls.append("run"), "gitea", "s", "main", str(tmp_path / "cp"), lambda: calls.append("pull"), {"availableNow": True})
    q.awaitTermination()
    assert calls == ["pull", "run"]


def test_instructions_survive_a_failing_refresh(spark):
    text = reindex.Instructions("old")
    text.refresh(lambda: 1 / 0)
    assert text.text == "old"
    with pytest.raises(ValueError):
        reindex.refresh_every(spark, 5, lambda: "", text)
    q = reindex.refresh_every(spark, 10, lambda: "new", text)
    q.stop()
    assert text.text == "new"


def test_limiter_batch_bursts(spark):
    from lectern.operators import limiter

    rows = [("a", f"2024-01-01 00:00:{s:02d}", i) for i, s in enumerate([0, 0, 0, 1, 11, 12])]
    df = spark.createDataFrame(rows, "k string, t string, i int").withColumn("t", F.to_timestamp("t"))
    got = {r["i"]: r["accepted"] for r in limiter.admitted(df, "k", "t", "i", 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False}
    rows = [(None, "2024-01-01 00:00:00", 0), (None, "2024-01-01 00:00:00", 1), ("a", None, 2), ("a", "2024-01-01 00:00:00", 3)]
    df = spark.createDataFrame(rows, "k string, t string, i int").withColumn("t", F.to_timestamp("t"))
    assert {r["i"]: r["accepted"] for r in limiter.admitted(df, "k", "t", "i", 1, 10).collect()} == {0: True, 1: False, 2: False, 3: True}


def test_limiter_takes_long_keys_in_one_pass(spark):
    from lectern.operators import limiter

    df = spark.range(200_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id")).alias("t"), F.col("id").alias("i"))
    assert limiter.admitted(df, "k", "t", "i", 1, 2).where("accepted").count() == 100_000


@pytest.mark.parametrize("idle_ms, again", [(1, True), (3_600_000, False)])
def test_idle_keys_lose_their_state(spark, tmp_path, idle_ms, again):
    """A bucket that was silent for longer than idle_ms is full once more; one that was not stays empty."""
    from lectern.streaming.limiter import admit

    schema = "key bigint, at bigint, order bigint"
    for run in range(2):
        spark.createDataFrame([(1, 1_000_000, run)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        requests = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = admit(requests, 1, 3600, idle_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
        out.trigger(availableNow=True).start().awaitTermination()
        time.sleep(1)
    accepted = {r["order"]: r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert accepted == {0: True, 1: again}
