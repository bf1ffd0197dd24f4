"""URL filter, pipeline and registry."""
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from bruteforce_katz import Katz, tokens
from bruteforce_simhash import components, groups
from fixtures import EDGE, empty, frame

from sensorspark.llm import decontaminate, host_reputation, knn_quality, packing, pii_crf, queries, simhash

SF = "/root/testdata/sf0.001"
URLS = ["http://www.example.com/en/1", "https://Example.COM/en/x?q=1", "http://a.example.com/EN/", "ftp://m.net/es/#x", "http://net/fr/", "http://x.org/fr/",
        "no scheme.com/en/", None, "", "http://", "http://com?x=/", "http://example.com", "http://blog.example.com/en/?a#b", "x://y://z.net/es/", "http://xnet/es/",
        "http://a.co.uk/", "http://b.a.co.uk/es/", "HTTP://UPPER.NET/FR/Q"]


def test_url_filter_against_duckdb(spark, tmp_path):
    pages = [(i, u, "h", "x") for i, u in enumerate(URLS * 3)] + [(0, URLS[0], "h", "x"), (None, "http://q.example.net/a", None, None)]
    labels = [(i, int(i % 3 != 0), int(i % 7 == 0), "com") for i in range(0, 50, 2)] + [(4, 0, None, None), (6, None, 1, None), (None, 0, 1, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, host string").write.parquet(str(tmp_path / "labels.parquet"))
    got = [tuple(r) for r in queries.op3_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()]
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE['op3_url_filter']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(pages)
    rules = {r[1] + r[2]: r[3] for r in got}
    assert rules["www.example.com/en/1"] == "www.example.com/en/" and rules["example.com/en/x"] == "example.com/en/"
    assert rules["a.example.com/EN/"] == "com/" and rules["m.net/es/"] == "net/es/" and rules["net/fr/"] == "net/fr/"
    assert rules["xnet/es/"] is None and rules[""] is None and rules["com"] is None


def test_bad_host_is_blocked_and_lone_outcomes_are_shrunk(spark):
    pages = [(i, "http://bad.example.org/x") for i in range(40)] + [(100 + i, "http://good.example.edu/x") for i in range(40)] + [(200, "http://new.example.edu/x")]
    labels = [(i, 0, 0) for i in range(40)] + [(100 + i, 1, 0) for i in range(40)] + [(200, 0, 0)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    v = {r.page_id: r.verdict for r in host_reputation.judge_urls(p, lab, []).collect()}
    assert v[0] == "block" and v[100] == "allow" and v[200] == "allow"
    assert host_reputation.judge_urls(p.filter("page_id < 0"), lab, []).count() == 0
    assert {r.verdict for r in host_reputation.judge_urls(p, lab.filter("doc_id < 0"), []).collect()} == {"allow"}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_pipeline_stages_against_brute_force(spark):
    """Each stage's result from its own input by other means."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "privacy", "packing"]

    good = corpus_pipeline.quality(spark, docs, SF)
    scores = {r.doc_id: r.score for r in knn_quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.schema == docs.schema and ids(good) == sorted(i for i, s in scores.items() if s >= 0.3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(good))
    clean = [i for i, q in labels.items() if q == 1 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)

    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    _, comp = components([i for i, _ in rows], [t for _, t in rows])
    assert one.schema == docs.schema and ids(one) == sorted(set(comp))

    clear = corpus_pipeline.benchmark_leaks(spark, docs, SF)
    bench = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, t in rows if any(b in decontaminate.normalised(t) for b in bench)}
    assert clear.schema == docs.schema and leaked and ids(clear) == sorted(i for i, _ in rows if i not in leaked)

    private = {r.doc_id: r for r in corpus_pipeline.privacy(spark, docs, SF).collect()}
    assert len(private) == len(rows)
    hidden = 0
    for i, t in rows:
        base = pii_crf.base_spans(t)
        hidden += sum(map(len, base))
        if not any(base):
            continue
        for own in base:
            for s, e in own:
                assert t[s:e] not in private[i].text
        assert private[i].n_chars == len(private[i].text)
    assert hidden > 3

    packed = corpus_pipeline.best_fit(spark, docs, SF).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.n_tokens
    assert total == {i: len(tokens(t)) for i, t in rows}


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(out.columns) >= {"doc_id", "bin_id", "capacity"} and 0 < out.select("doc_id").distinct().count() < docs.count()


def test_pipeline_stages_on_no_rows(spark):
    none = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0
        assert name == "packing" or out.columns == none.columns


def test_pipeline_stages_on_awkward_rows(spark):
    """NULLs, empty and long texts, repeated rows and clashing columns pass
    every stage; one row of each group of near-duplicates stays, whatever its
    id; packing places every row."""
    docs = frame(spark, EDGE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        n = {"quality": range(0, len(EDGE) + 1), "near_duplicates": [len(set(groups([t for _, t in EDGE])))], "benchmark": [len(EDGE)], "privacy": [len(EDGE)]}[name]
        assert out.count() in n, name
    packed = corpus_pipeline.best_fit(spark, docs, SF)
    assert packed.agg({"n_tokens": "sum"}).first()[0] == sum(len(tokens(t)) for _, t in EDGE)


def test_registered_katz_is_a_trigram_model(spark, tmp_path):
    rows = [(i, f"a b c{i % 3} a b d b c{i % 2} a") for i in range(40)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.op1_katz(spark, str(tmp_path)).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    three, two = Katz(train, 3), Katz(train, 2)
    assert got == pytest.approx({i: three.score(t) for i, t in rows})
    assert any(abs(two.score(t) - got[i]) > 1e-6 for i, t in rows)


def test_one_query_for_each_operator():
    names = [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES]
    assert sorted(names) == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_library_stands_without_the_subpackage():
    import subprocess
    import sys
    code = ("import sys; sys.modules['sensorspark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); assert 'feature_table' in q and 'pipeline' not in q and not any(x.startswith('op1') for x in q)")
    import os
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_pipeline_leaves_its_result_only(spark):
    import os

    from sensorspark.session import checkpoint_dir
    root = f"{checkpoint_dir(spark)}/llm"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-packing-") and out.count() > 0


def test_a_broken_import_is_not_excused():
    import os
    import subprocess
    import sys
    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['zstandard'] = None; import __spark_entry__"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode != 0


@pytest.mark.parametrize("limit", [1, 3])
def test_local_links_span_the_components(limit):
    import numpy as np
    rng = np.random.default_rng(limit)
    fp = rng.integers(0, 1 << 12, 60, dtype=np.uint64)
    found = simhash.local_links(fp, limit, block=7)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in found:
        assert bin(int(fp[a] ^ fp[b])).count("1") <= limit
        root[find(a)] = find(b)
    for a in range(60):
        for b in range(60):
            if bin(int(fp[a] ^ fp[b])).count("1") <= limit:
                assert find(a) == find(b)


def test_frames_have_clashing_columns(spark):
    assert len(frame(spark, [(1, "a")]).columns) > 15 and packing.CAPACITIES
