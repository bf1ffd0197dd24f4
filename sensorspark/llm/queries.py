"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorspark.llm import (bitplane_kmeans, decontaminate, host_reputation, katz, knn_quality, licenses, merkle_manifest, packing, pii_crf,
                             secret_scan, simhash, suffix_dedup, syncmers)
from sensorspark.llm.common import read_table

URL_RULES = (
    host_reputation.Rule("com", "/", "allow"),
    host_reputation.Rule("example.com", "/en/", "block"),
    host_reputation.Rule("www.example.com", "/en/", "allow"),
    host_reputation.Rule("net", "/es/", "block"),
    host_reputation.Rule("net", "/fr/", "block"),
)


def op1_katz(spark, sf_dir):
    """Every document's log10 probability under the Katz trigram model of the
    training folds (crc32 mod 7 is not 2), beside the add-one unigram base."""
    return katz.score(read_table(spark, sf_dir, "documents"), order=3, folds=7, held=2)


def op2_syncmers(spark, sf_dir):
    """Closed-syncmer fingerprints of every text and its half-edited text."""
    return syncmers.compare_neighbours(read_table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    """Every page judged by the url rules, else by its host's posterior bad rate."""
    return host_reputation.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op4_knn_quality(spark, sf_dir):
    """Quality score of every document; fold 0 of crc32 mod 5 is held out."""
    return knn_quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.3, folds=5, held=0)


def op5_suffix_dedup(spark, sf_dir):
    """Every document less the bytes of 400-byte strings that also start elsewhere."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), window=400)


def op6_decontaminate(spark, sf_dir):
    """Every benchmark item found within its edit budget in a document."""
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_simhash(spark, sf_dir):
    """SimHash (3-word shingles) components within 3 bits, one row a document."""
    nd = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return nd.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark, sf_dir):
    """Personal data spans of every document: patterns and skip-chain CRF."""
    return pii_crf.pii_spans(read_table(spark, sf_dir, "documents"))


def op9_best_fit(spark, sf_dir):
    """Every document's pieces in bins of 512 to 4096 tokens."""
    return packing.best_fit(read_table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    """Licence families of every document, confirmed against the notices."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op11_bitplane_clusters(spark, sf_dir):
    """Five exact rounds of 40 centroids over every 64-component vector."""
    return bitplane_kmeans.cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def op12_secrets(spark, sf_dir):
    """Secret spans of every document: patterns and entropy windows."""
    return secret_scan.secret_spans(read_table(spark, sf_dir, "documents"))


def op13_merkle(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, folded after tampering."""
    return merkle_manifest.manifest(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_katz, op2_syncmers, op3_url_filter, op4_knn_quality, op5_suffix_dedup, op6_decontaminate, op7_simhash, op8_pii, op9_best_fit,
                                   op10_licenses, op11_bitplane_clusters, op12_secrets, op13_merkle)}

_LEVEL = """greatest(0.001, least(0.5, (ss / (mean * (1 - mean)) - df) / (w - df)))"""


def _concentration(name: str, level: str, parent: str) -> str:
    return f"""
{name} AS (
  SELECT CASE WHEN mean <= 0 OR mean >= 1 OR ss IS NULL OR w - df <= 0 THEN 1000.0 ELSE 1.0 / {_LEVEL} - 1.0 END AS m
  FROM (SELECT sum(k2 - k * k / n) AS ss, sum(g - 1) AS df, sum(n - n2 / n) AS w
        FROM (SELECT {parent} AS parent, sum(n) AS n, sum(k) AS k, count(*) AS g, sum(n * n) AS n2, sum(k * k / n) AS k2
              FROM {level} WHERE n > 0 GROUP BY 1)), total)"""


def _url_oracle() -> str:
    fits = "\n".join(
        f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
        for r in sorted(URL_RULES, key=lambda r: (-len(r.text), -len(r.host), r.text)))
    verdicts = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in URL_RULES)
    two = ", ".join(f"'{s}'" for s in host_reputation.TWO_LABEL_SUFFIXES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
outcome AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS k
  FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
counted AS (
  SELECT host, sum(coalesce(n, 0))::DOUBLE AS n, sum(coalesce(k, 0))::DOUBLE AS k, string_split(host, '.') AS l
  FROM parts LEFT JOIN outcome ON page_id = doc_id GROUP BY host),
split AS (SELECT *, array_to_string(l[-2:], '.') AS two FROM counted),
hosts AS (
  SELECT host, n, k, CASE WHEN two IN ({two}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
         CASE WHEN two IN ({two}) THEN two WHEN len(l) > 1 THEN l[-1] ELSE '' END AS suffix FROM split),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, 1 AS every, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
total AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0 END AS mean FROM suffixes),
{_concentration("mh", "hosts", "domain")},
{_concentration("md", "domains", "suffix")},
{_concentration("ms", "suffixes", "every")},
s AS (SELECT suffix, (k + ms.m * mean) / (n + ms.m) AS rate FROM suffixes, ms, total),
d AS (SELECT domains.domain, domains.suffix, (k + md.m * s.rate) / (n + md.m) AS rate
      FROM domains JOIN s USING (suffix), md),
h AS (SELECT host, k + mh.m * d.rate AS a, n - k + mh.m * (1 - d.rate) AS b
      FROM hosts JOIN d USING (domain, suffix), mh),
rep AS (SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS low FROM h),
ruled AS (SELECT *, CASE
{fits} END AS rule FROM parts)
SELECT page_id, ruled.host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled LEFT JOIN rep USING (host)
"""



def _cluster_oracle(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = [f"""
v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q,
         sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM v ORDER BY h, q LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT r, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q,
         min(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * {k} + k) AS best
  FROM v, c{i} AS c GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT k, list(f ORDER BY j) AS q
  FROM (SELECT k, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
        FROM (SELECT best % {k} AS k, unnest(q) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j) GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} AS c LEFT JOIN m{i} AS m ON m.k = c.k)""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance,
       CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON c.k = best % {k}
"""


def _manifest_oracle() -> str:
    def h(text):
        fields = " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({fields})"
    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"""xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda s, x: list_reduce(range(8), lambda c, i: {bit}, xor(s, x)), 4294967295), 4294967295)"""
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, leaf, coalesce(CASE WHEN even THEN tampered END, leaf) AS shown,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {h("text")} AS leaf, {h("replace(text, chr(10), '')")} AS tampered, {crc} % 2 = 0 AS even FROM documents)),
own AS (
  SELECT 0 AS level, source, pos AS i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM own WHERE n > 1 GROUP BY level, source, i // 3, n),
subroots AS (SELECT source, digest, level AS height, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS s, count(*) OVER () AS n FROM own WHERE n = 1),
every AS (
  SELECT 0 AS level, s AS i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM every WHERE n > 1 GROUP BY level, i // 3, n),
root AS (SELECT digest AS root FROM every WHERE n = 1),
numbered AS (
  SELECT row_number() OVER () AS r, l.*, s, height, b.digest AS subroot FROM leaves AS l JOIN subroots AS b ON l.source IS NOT DISTINCT FROM b.source),
step AS (
  SELECT r, o.level AS level, string_agg(CASE WHEN o.i < pos // CAST(power(3, o.level) AS BIGINT) THEN digest END, '' ORDER BY o.i) AS lo,
         string_agg(CASE WHEN o.i > pos // CAST(power(3, o.level) AS BIGINT) THEN digest END, '' ORDER BY o.i) AS hi
  FROM numbered JOIN own AS o ON o.source IS NOT DISTINCT FROM numbered.source AND o.n > 1
   AND o.i // 3 = pos // CAST(power(3, o.level) AS BIGINT) // 3 GROUP BY r, o.level
  UNION ALL
  SELECT r, any_value(height) + e.level, string_agg(CASE WHEN e.i < s // CAST(power(3, e.level) AS BIGINT) THEN digest END, '' ORDER BY e.i),
         string_agg(CASE WHEN e.i > s // CAST(power(3, e.level) AS BIGINT) THEN digest END, '' ORDER BY e.i)
  FROM numbered JOIN every AS e ON e.n > 1 AND e.i // 3 = s // CAST(power(3, e.level) AS BIGINT) // 3 GROUP BY r, e.level),
steps AS (SELECT r, level, coalesce(lo, '') AS lo, coalesce(hi, '') AS hi FROM step),
proof AS (SELECT r, sha256(string_agg(lo || hi, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY r),
fold AS (
  SELECT r, 0 AS level, shown AS node FROM numbered
  UNION ALL
  SELECT fold.r, fold.level + 1, sha256(lo || node || hi) FROM fold JOIN steps ON steps.r = fold.r AND steps.level = fold.level),
folded AS (SELECT r, arg_max(node, level) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM numbered JOIN folded USING (r) LEFT JOIN proof USING (r), root
"""


ORACLE = {"op3_url_filter": _url_oracle(), "op11_bitplane_clusters": _cluster_oracle(), "op13_merkle": _manifest_oracle()}
