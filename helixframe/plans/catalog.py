"""The registered queries on the given tables, and their SQL.

Sequences are what is left of `documents` (or `benchmark`) when only the letters ACGT are read; vectors are `embeddings`.
Every query reads its whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import sequences as S
from ..functions import tables
from ..functions.distance import l1, pairs_within, squared_l2
from ..operators import clustering as C
from ..operators import compare as K
from ..operators import layers as L
from ..operators import projection as P
from ..operators import sequences as O
from ..sources import pictures, split_sets
from ..sources import readers as R
from ..sources import writers as W
from ..storage import saved, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MINPTS, EPSILONS = 3, (1.14, 1.15, 1.16)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dna(texts: DataFrame, key: str) -> DataFrame:
    return texts.where("text is not null").select(F.col(key).alias("seq_id"), F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq"))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return dna(table(spark, d, "documents"), "doc_id")


def probes(spark: SparkSession, d: str) -> DataFrame:
    return dna(table(spark, d, "benchmark"), "item_id")


def protein(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("seq_id"), F.col("embedding").cast("array<double>").alias("values"))


def target(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("seq_id"), F.col("label").cast("int").alias("target"))


def mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("mask"))


SEQ = "seqs AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents WHERE text IS NOT NULL)"
PROBE = "probes AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark WHERE text IS NOT NULL)"
KMER2 = "km AS (SELECT seq_id, kmer, count(*) AS cnt FROM (SELECT seq_id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 2))) AS kmer FROM seqs) GROUP BY ALL)"


@query(f"WITH {SEQ} SELECT seq_id, seq FROM seqs")
def seq_view(spark, d):
    return seqs(spark, d)


@query(f"WITH {SEQ} SELECT seq_id, length(seq) AS seq_len FROM seqs")
def seq_lengths(spark, d):
    return O.with_lengths(seqs(spark, d)).select("seq_id", "seq_len")


@query(f"WITH {SEQ} SELECT max(length(seq)) AS max_len FROM seqs")
def max_length(spark, d):
    return O.max_length(seqs(spark, d))


@query("SELECT p_partkey, upper(regexp_extract(p_name, '^\\s*(\\S+)', 1)) AS token FROM part")
def first_token(spark, d):
    return table(spark, d, "part").select("p_partkey", S.first_token(F.col("p_name")).alias("token"))


MASKED = "WITH {seq}, m AS (SELECT doc_id AS seq_id, quality AS mask FROM labels) SELECT seq_id, CASE WHEN mask = 1 THEN {x} ELSE seq END AS seq FROM seqs LEFT JOIN m USING (seq_id)"


@query(MASKED.format(seq=SEQ, x="translate(reverse(seq), 'ACGT', 'TGCA')"))
def reverse_complement_masked(spark, d):
    return O.reverse_complement_masked(seqs(spark, d), mask(spark, d))


@query(MASKED.format(seq=SEQ, x="reverse(seq)"))
def reverse_masked(spark, d):
    return O.reverse_masked(seqs(spark, d), mask(spark, d))


@query(f"WITH {SEQ} SELECT seq_id, translate(seq, 'ACGT', '0123') AS code, seq FROM seqs")
def encode_2bit(spark, d):
    coded = seqs(spark, d).select("seq_id", S.encode_2bit(F.col("seq")).alias("code"))
    return coded.select("seq_id", "code", S.decode_2bit(F.col("code")).alias("seq"))


@query(f"WITH {SEQ}, {KMER2} SELECT * FROM km")
def kmer_counts_k2(spark, d):
    return O.kmer_counts(seqs(spark, d), 2)


UNIVERSE2 = "u AS (SELECT n AS kmer_idx, substr('ACGT', (n % 4 + 1)::BIGINT, 1) || substr('ACGT', (n // 4 + 1)::BIGINT, 1) AS kmer FROM range(16) t(n))"


@query(f"WITH {SEQ}, {KMER2}, {UNIVERSE2} SELECT seq_id, string_agg(coalesce(cnt, 0)::VARCHAR, ',' ORDER BY kmer_idx) AS counts FROM (SELECT seq_id, kmer_idx, kmer FROM seqs, u) LEFT JOIN km USING (seq_id, kmer) GROUP BY seq_id")
def kmer_dense_k2(spark, d):
    return O.kmer_dense(seqs(spark, d), 2).select("seq_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(f"WITH {SEQ}, {KMER2}, {UNIVERSE2} SELECT kmer_idx, kmer, coalesce(sum(cnt), 0)::BIGINT AS total FROM u LEFT JOIN km USING (kmer) GROUP BY ALL")
def kmer_universe_totals(spark, d):
    counts = O.kmer_counts(seqs(spark, d), 2).groupBy("kmer").agg(F.sum("cnt").alias("total"))
    return S.dna_kmer_universe(spark, 2).join(counts, "kmer", "left").select("kmer_idx", "kmer", F.coalesce("total", F.lit(0)).alias("total"))


@query(f"WITH {SEQ}, {KMER2}, {UNIVERSE2} SELECT seq_id, 'sequence_' || seq_id || chr(9) || string_agg(coalesce(cnt, 0)::VARCHAR, chr(9) ORDER BY kmer_idx) AS line FROM (SELECT seq_id, kmer_idx, kmer FROM seqs, u) LEFT JOIN km USING (seq_id, kmer) GROUP BY seq_id")
def kmer_table_text(spark, d):
    return O.kmer_lines(O.kmer_dense(seqs(spark, d), 2))


PROTEIN = "ACDEFGHIKLMNPQRSTVWY"


@query(
    f"WITH p AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark WHERE text IS NOT NULL), "
    f"k AS (SELECT kmer, count(*) AS total FROM (SELECT unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 2))) AS kmer FROM p) GROUP BY kmer), "
    f"u AS (SELECT n AS kmer_idx, substr('{PROTEIN}', (n // 20 + 1)::BIGINT, 1) || substr('{PROTEIN}', (n % 20 + 1)::BIGINT, 1) AS kmer FROM range(400) t(n)) "
    f"SELECT kmer_idx, kmer, coalesce(total, 0) AS total FROM u LEFT JOIN k USING (kmer)"
)
def protein_kmer_totals_k2(spark, d):
    counts = O.kmer_counts(protein(spark, d), 2, protein=True).groupBy("kmer").agg(F.sum("cnt").alias("total"))
    return S.protein_kmer_universe(spark, 2).join(counts, "kmer", "left").select("kmer_idx", "kmer", F.coalesce("total", F.lit(0)).alias("total"))


@query(f"WITH {SEQ} SELECT min(seq_id) AS seq_id, seq, count(*) AS multiplicity FROM seqs GROUP BY seq")
def sequence_multiplicity(spark, d):
    return O.multiplicity(seqs(spark, d))


WRAP = "regexp_replace({x}, '(.{{50}})', '\\1' || chr(10), 'g')"


def wrap_sql(x: str) -> str:
    return f"rtrim({WRAP.format(x=x)}, chr(10))"


@query(f"WITH {SEQ} SELECT seq_id, n AS multiplicity, '>sequence_' || seq_id || '_mutiplicity_' || n || chr(10) || {wrap_sql('seq')} AS record, row_number() OVER (ORDER BY n, seq_id) - 1 AS rank FROM (SELECT min(seq_id) AS seq_id, seq, count(*) AS n FROM seqs GROUP BY seq)")
def multiplicity_fasta(spark, d):
    return O.multiplicity_fasta(seqs(spark, d))


@query(f"WITH {SEQ} SELECT seq_id, '>sequence_' || seq_id || chr(10) || {wrap_sql('seq')} AS record FROM seqs")
def fasta_text(spark, d):
    return O.fasta_text(seqs(spark, d))


CONS = f"""WITH {SEQ}, c AS (SELECT seq_id, unnest(string_split(seq, '')) AS c, unnest(range(length(seq))) AS pos FROM seqs WHERE length(seq) > 0),
n AS (SELECT pos, count(*) FILTER (c = 'A') AS n_a, count(*) FILTER (c = 'C') AS n_c, count(*) FILTER (c = 'G') AS n_g, count(*) FILTER (c = 'T') AS n_t FROM c GROUP BY pos),
t AS (SELECT count(*) AS n FROM seqs),
k AS (SELECT pos, CASE greatest(n_a, n_c, n_g, n_t) WHEN n_a THEN 'A' WHEN n_c THEN 'C' WHEN n_g THEN 'G' ELSE 'T' END AS base, n_a, n_c, n_g, n_t, n_a / n AS f_a, n_c / n AS f_c, n_g / n AS f_g, n_t / n AS f_t, greatest(n_a, n_c, n_g, n_t) / n AS top FROM n, t)
"""


@query(CONS + "SELECT pos, base, n_a, n_c, n_g, n_t, round(f_a, 9) AS f_a, round(f_c, 9) AS f_c, round(f_g, 9) AS f_g, round(f_t, 9) AS f_t FROM k")
def consensus(spark, d):
    return O.consensus(seqs(spark, d)).select("pos", "base", "n_a", "n_c", "n_g", "n_t", *[F.round(f"f_{b}", 9).alias(f"f_{b}") for b in "acgt"])


@query(CONS + "SELECT string_agg(base, '' ORDER BY pos) AS consensus FROM k")
def consensus_string(spark, d):
    return O.consensus_string(O.consensus(seqs(spark, d)))


@query(CONS + "SELECT round(avg(top), 6) AS mean_max, round(stddev_pop(top), 6) AS sigma_max FROM k")
def consensus_stats(spark, d):
    return O.consensus_stats(O.consensus(seqs(spark, d))).select(F.round("mean_max", 6).alias("mean_max"), F.round("sigma_max", 6).alias("sigma_max"))


@query(CONS + "SELECT pos, base, round(top, 9) AS max_share, top < 0.85 AS low_confidence FROM k")
def consensus_report(spark, d):
    return O.consensus_report(O.consensus(seqs(spark, d))).withColumn("max_share", F.round("max_share", 9))


def digest_sql(site: str, before: int, after: int) -> str:
    fixed = " AND ".join(f"ch[i + {j - before + 1}] = '{c}'" for j, c in enumerate(site) if c != "N")
    return f"""WITH {SEQ}, s AS (SELECT seq_id, seq, string_split(seq, '') AS ch FROM seqs),
c AS (SELECT seq_id, seq, [0] || list_filter(range({before}, length(seq) - {after}), lambda i: {fixed}) AS cuts FROM s),
f AS (SELECT seq_id, seq, unnest(cuts) AS a, unnest(list_append(cuts[2:], length(seq))) AS z, unnest(range(len(cuts))) AS fragment FROM c)
SELECT seq_id, fragment, substr(seq, a + 1, z - a) AS fragment_seq, z - a AS fragment_len FROM f"""


def register_digest(name: str, enzyme) -> None:
    def run(spark, d):
        return O.digest(seqs(spark, d), enzyme)

    run.__name__ = name
    query(digest_sql(*(S.ENZYMES[enzyme] if isinstance(enzyme, str) else enzyme)))(run)


for _name, _enzyme in (("digest_xbai", "XbaI"), ("digest_hindiii", "HindIII"), ("digest_xmni", "XmnI"), ("digest_short_site", ("TCT", 1, 2))):
    register_digest(_name, _enzyme)


@query(f"WITH {SEQ}, {KMER2} SELECT * FROM km")
def udtf_fasta_kmers(spark, d):
    tables.register(spark)
    return spark.sql("SELECT seq_id, kmer, cnt FROM {own}, LATERAL fasta_kmers(seq, 2)", own=seqs(spark, d))


@query(digest_sql(*S.ENZYMES["XbaI"]))
def udtf_digest(spark, d):
    tables.register(spark)
    return spark.sql("SELECT seq_id, fragment, fragment_seq, fragment_len FROM {own}, LATERAL digest(seq, 'XbaI')", own=seqs(spark, d))


@query(f"WITH {SEQ} SELECT seq_id, seq FROM seqs WHERE length(seq) BETWEEN 100 AND 250")
def length_window(spark, d):
    return O.length_window(seqs(spark, d), 200, 50, 100)


@query(f"WITH {SEQ}, {PROBE} SELECT seq_id, seq FROM seqs WHERE seq IN (SELECT seq FROM seqs GROUP BY seq HAVING count(*) > 1)")
def exact_lookup(spark, d):
    own = seqs(spark, d)
    return O.exact_lookup(own, O.multiplicity(own).where("multiplicity > 1"))


@query(f"WITH {SEQ} SELECT seq_id, seq FROM seqs WHERE seq IN (SELECT seq FROM seqs WHERE seq_id % 50 = 0)")
def exact_lookup_probes(spark, d):
    """The probes are the sequences whose id 50 divides; all sequences are searched."""
    own = seqs(spark, d)
    return O.exact_lookup(own, own.where("seq_id % 50 = 0"))


@query("SELECT p_partkey AS seq_id, unnest(list_transform(range(CAST(power(4, n) AS BIGINT)), lambda k: k)) AS k FROM (SELECT p_partkey, length(s) - length(replace(s, 'N', '')) AS n FROM (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACGTN]', '', 'g') AS s FROM part))")
def expand_n(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.regexp_replace(F.upper("p_name"), "[^ACGTN]", "").alias("seq"))
    return O.n_expanded(own).select("seq_id", F.col("k").cast("long").alias("k"))


@query(
    "WITH RECURSIVE s AS (SELECT p_partkey AS seq_id, regexp_replace(upper(p_name), '[^ACGTN]', '', 'g') AS s FROM part), "
    "n AS (SELECT seq_id, s, length(s) - length(replace(s, 'N', '')) AS n FROM s), "
    "e AS (SELECT seq_id, unnest(range(CAST(power(4, n) AS BIGINT))) AS k, s FROM n), "
    "r(seq_id, k, rest, done, todo) AS (SELECT seq_id, k, k, '', s FROM e UNION ALL "
    "SELECT seq_id, k, CASE WHEN todo[1] = 'N' THEN rest // 4 ELSE rest END, done || CASE WHEN todo[1] = 'N' THEN substr('ACGT', (rest % 4 + 1)::BIGINT, 1) ELSE todo[1] END, substr(todo, 2) FROM r WHERE todo <> '') "
    "SELECT seq_id, k, done AS seq FROM r WHERE todo = ''"
)
def udtf_expand_n(spark, d):
    tables.register(spark)
    own = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.regexp_replace(F.upper("p_name"), "[^ACGTN]", "").alias("seq"))
    return spark.sql("SELECT seq_id, k, expanded AS seq FROM {own}, LATERAL expand_n(seq)", own=own)


@query(ORACLES["udtf_expand_n"])
def expand_n_sequences(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.regexp_replace(F.upper("p_name"), "[^ACGTN]", "").alias("seq"))
    return O.n_expanded(own).select("seq_id", F.col("k").cast("long").alias("k"), "seq")


LINES = "lines AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS n, value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {LINES} SELECT n AS line_no, CASE WHEN n % 4 = 0 THEN regexp_replace(value, '^@', '>') ELSE value END AS value FROM lines WHERE n % 4 < 2")
def fastq_lines(spark, d):
    """The documents as one file of lines, read as four-line records."""
    path = shared_path(spark)
    W.write_text(table(spark, d, "documents").where("text is not null"), "text", path, "doc_id")
    return R.fastq_to_fasta(spark, path)


@query(f"WITH {SEQ} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, seq, length(seq) AS seq_len FROM seqs")
def fasta_round_trip(spark, d):
    """Written as FASTA and read again: ids are places in the file."""
    path = shared_path(spark)
    W.write_fasta(seqs(spark, d), path)
    return R.read_fasta(spark, path)


@query(f"WITH {SEQ}, {KMER2}, {UNIVERSE2} SELECT row_number() OVER (ORDER BY seq_id) - 1 AS seq_id, counts FROM (SELECT seq_id, string_agg(coalesce(cnt, 0)::VARCHAR, ',' ORDER BY kmer_idx) AS counts FROM (SELECT seq_id, kmer_idx, kmer FROM seqs, u) LEFT JOIN km USING (seq_id, kmer) GROUP BY seq_id)")
def kmer_table_round_trip(spark, d):
    path = shared_path(spark)
    W.write_kmer_table(O.kmer_dense(seqs(spark, d), 2), path)
    return R.read_kmer_table(spark, path).select("seq_id", F.array_join(F.transform("values", lambda v: v.cast("long").cast("string")), ",").alias("counts"))


@query(f"WITH {SEQ} SELECT count(*) AS n_samples, 16 AS n_features FROM seqs")
def kmer_table_shape(spark, d):
    path = shared_path(spark)
    W.write_kmer_table(O.kmer_dense(seqs(spark, d), 2), path)
    return R.table_shape(R.read_kmer_table(spark, path))


@query("SELECT row_number() OVER (ORDER BY vec_id, k) - 1 AS n, round(v, 6) AS value FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS k FROM embeddings)")
def projection_round_trip(spark, d):
    """Vectors written with six decimals and read again, value by value."""
    path = shared_path(spark)
    W.write_projections(points(spark, d), path)
    dims = len(points(spark, d).first()["values"])
    rows = R.read_projections(spark, path, dims).select("seq_id", F.posexplode("values").alias("k", "v"))
    return rows.select((F.col("seq_id") * dims + F.col("k")).alias("n"), F.round("v", 6).alias("value"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq_id, quality AS mask FROM labels")
def mask_round_trip(spark, d):
    path = shared_path(spark)
    W.write_text(mask(spark, d).select("seq_id", F.col("mask").cast("string").alias("mask")), "mask", path, "seq_id")
    return R.read_mask(spark, path)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS seq_id, regexp_extract(p_name, '^\\s*(\\S+)', 1) AS annotation FROM part")
def annotation_round_trip(spark, d):
    path = shared_path(spark)
    W.write_text(table(spark, d, "part"), "p_name", path, "p_partkey")
    return R.read_annotation(spark, path)


@query("SELECT o_orderkey::INTEGER AS layer, o_totalprice::DOUBLE AS epsilon FROM orders")
def clustering_log_round_trip(spark, d):
    """Lines of a clustering log among others, one for every order."""
    path = shared_path(spark)
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Epsilon at layer "), "o_orderkey", F.lit(": "), F.col("o_totalprice").cast("double").cast("string")).alias("line"))
    W.write_text(rows.unionByName(rows.select("o_orderkey", F.lit("Coverage at layer").alias("line"))), "line", path, "o_orderkey")
    return R.read_clustering_log(spark, path)


def sw_cte(pairs: str) -> str:
    """CTEs ending in sw(i, j, dist), the alignment distance of pairs(i, j, x, y): one row of the score matrix a step, as a list."""
    letters = lambda c: f"CASE WHEN length({c}) < 2 THEN ['$'] ELSE list_append(string_split(substr({c}, 2), ''), '$') END"
    score = "greatest(0, h[k] + CASE WHEN ca[k] = cb[step + 1] THEN 4 ELSE -4 END, h[k + 1] - 3)"
    row = "list_transform(range(1, len(t) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda z: t[z] - 3 * (k - z))))"
    return f"""sp AS MATERIALIZED (SELECT i, j, {letters('x')} AS ca, {letters('y')} AS cb, 4 * greatest(length(x), length(y)) AS top FROM ({pairs})),
sr(i, j, step, h, mx) AS (SELECT i, j, 0, list_transform(range(len(ca) + 1), lambda k: 0::BIGINT), 0::BIGINT FROM sp
  UNION ALL SELECT i, j, step + 1, [0::BIGINT] || g, greatest(mx, list_max(g)) FROM (
    SELECT i, j, step, mx, {row} AS g FROM (
      SELECT sp.i, sp.j, step, mx, list_transform(range(1, len(ca) + 1), lambda k: {score}) AS t FROM sr JOIN sp ON sp.i = sr.i AND sp.j = sr.j WHERE step < len(cb)))),
sw AS MATERIALIZED (SELECT sr.i, sr.j, (top - mx)::DOUBLE AS dist FROM sr JOIN sp ON sp.i = sr.i AND sp.j = sr.j WHERE step = len(cb))"""


def near_sql(where: str, most: int) -> str:
    """The documents' sequences within an alignment distance of a probe."""
    pairs = f"SELECT s.seq_id AS i, p.seq_id AS j, s.seq AS x, p.seq AS y FROM seqs s JOIN probes p ON 4 * abs(length(s.seq) - length(p.seq)) <= {most} WHERE {where}"
    return f"WITH RECURSIVE {SEQ}, {PROBE}, {sw_cte(pairs)} SELECT i AS seq_id, j AS target_id, dist FROM sw WHERE dist <= {most}"


#: Probes against their reverse complements: all distances, and those of the probes among themselves.
COMPLEMENTS = f"""WITH RECURSIVE {PROBE}, b AS (SELECT seq_id, translate(reverse(seq), 'ACGT', 'TGCA') AS seq FROM probes),
{sw_cte("SELECT a.seq_id AS i, b.seq_id AS j, a.seq AS x, b.seq AS y FROM probes a, b UNION ALL SELECT a.seq_id, -1 - b.seq_id, a.seq, b.seq FROM probes a, probes b")} """


@query(near_sql("true", 120))
def sw_filter(spark, d):
    return O.near_sequences(seqs(spark, d), probes(spark, d), 120)


@query(near_sql("length(s.seq) BETWEEN 50 AND 90", 150))
def satellites(spark, d):
    return O.satellites(seqs(spark, d), probes(spark, d), 70, 20, 20, 150)


@query(
    f"WITH RECURSIVE {PROBE}, {sw_cte('SELECT a.seq_id AS i, -b.seq_id - 1 AS j, reverse(b.seq) AS x, a.seq AS y FROM probes a, probes b')} "
    "SELECT j AS query_id, arg_min(i, struct_pack(dist := dist, i := i)) AS seq_id, min(dist) AS dist FROM sw GROUP BY j"
)
def sw_closest(spark, d):
    return O.closest(probes(spark, d), probes(spark, d).select((-F.col("seq_id") - 1).alias("seq_id"), F.reverse("seq").alias("seq")))


@query(COMPLEMENTS + "SELECT round(avg(dist), 6) AS mean, round(sqrt(var_pop(dist) * count(*)) / (2 * (SELECT count(*) FROM probes)), 6) AS sigma, round(stddev_pop(dist), 6) AS stddev_pop, min(dist) AS shortest, max(dist) AS longest FROM sw WHERE j >= 0")
def sw_compare_stats(spark, d):
    a = probes(spark, d)
    b = a.select("seq_id", S.reverse_complement(F.col("seq")).alias("seq"))
    n = a.count()
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "sigma", "stddev_pop")]
    return K.distance_stats(K.distance_matrix(a, b), n, n).select(*rounded, "shortest", "longest")


@query(
    COMPLEMENTS + "SELECT round(avg(CASE WHEN x < y THEN 1 - x / y WHEN x = y THEN 0.0 ELSE y / x - 1 END), 6) AS silhouette FROM (SELECT i, sum(dist) FILTER (j < 0) / ((SELECT count(*) FROM probes) - 1) AS x, sum(dist) FILTER (j >= 0) / (SELECT count(*) FROM probes) AS y FROM sw GROUP BY i)"
)
def sw_silhouette(spark, d):
    a = probes(spark, d)
    found = K.silhouette(a, a.select("seq_id", S.reverse_complement(F.col("seq")).alias("seq")))
    return found.select(F.round("silhouette", 6).alias("silhouette"))


@query(
    f"WITH RECURSIVE {PROBE}, {sw_cte('SELECT a.seq_id AS i, b.seq_id AS j, a.seq AS x, b.seq AS y FROM probes a, probes b')}, "
    "p AS MATERIALIZED (SELECT i, j FROM sw WHERE dist <= 150), d AS MATERIALIZED (SELECT i, count(*) AS n FROM p GROUP BY i), "
    "r(seed, id) AS (SELECT i, i FROM d WHERE n > 2 UNION SELECT r.seed, p.j FROM r JOIN d ON d.i = r.id JOIN p ON p.i = r.id WHERE d.n > 2 OR (d.n = 2 AND r.id > r.seed)) "
    "SELECT dense_rank() OVER (ORDER BY l) - 1 AS cluster, id AS seq_id FROM (SELECT id, min(seed) AS l FROM r GROUP BY id)"
)
def sw_dbscan(spark, d):
    return C.dbscan(probes(spark, d), 150, 2, "sw")


@query(
    f"WITH RECURSIVE {PROBE}, {sw_cte('SELECT a.seq_id AS i, b.seq_id AS j, a.seq AS x, b.seq AS y FROM probes a JOIN probes b ON b.seq_id < a.seq_id')}, "
    "km AS (SELECT seq_id, kmer, count(*) AS n FROM (SELECT seq_id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 2))) AS kmer FROM probes) GROUP BY ALL), "
    "dv AS (SELECT i, j, u.kmer, coalesce(a.n, 0) - coalesce(b.n, 0) AS v FROM sw JOIN (SELECT DISTINCT kmer FROM km) u ON true LEFT JOIN km a ON a.seq_id = i AND a.kmer = u.kmer LEFT JOIN km b ON b.seq_id = j AND b.kmer = u.kmer) "
    "SELECT i, j, dist AS dist_sw, l1::DOUBLE AS dist_l1, round(sqrt(l2), 6) AS dist_l2 FROM sw JOIN (SELECT i, j, sum(abs(v)) AS l1, sum(v * v) AS l2 FROM dv GROUP BY ALL) USING (i, j)"
)
def sw_norms(spark, d):
    own = probes(spark, d)
    rows = K.compare_norms(own, O.kmer_dense(own, 2).select("seq_id", F.col("counts").cast("array<double>").alias("values")))
    return rows.withColumn("dist_l2", F.round("dist_l2", 6))


E_CTE = "e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
SQ = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
ABS = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])))"


def pairs_cte(metric: str, eps: float) -> str:
    return f"{E_CTE}, p AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {'sqrt(' + SQ + ')' if metric == 'l2' else ABS} AS dist FROM e a, e b WHERE {SQ if metric == 'l2' else ABS} <= {eps * eps if metric == 'l2' else eps!r})"


@query(f"WITH {pairs_cte('l2', 1.1)} SELECT i, j, round(dist, 6) AS dist FROM p")
def l2_pairs(spark, d):
    return pairs_within(points(spark, d), 1.1, "l2").withColumn("dist", F.round("dist", 6))


@query(f"WITH {pairs_cte('l1', 7.0)} SELECT i, j, round(dist, 6) AS dist FROM p")
def l1_pairs(spark, d):
    return pairs_within(points(spark, d), 7.0, "l1").withColumn("dist", F.round("dist", 6))


@query(f"WITH {pairs_cte('l1', 7.0)} SELECT i, j, round(dist, 6) AS dist FROM p")
def l1_pairs_by_function(spark, d):
    """The metric is a function of two columns, and sums differ by the distance at most."""
    return pairs_within(points(spark, d), 7.0, l1, bound=lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).withColumn("dist", F.round("dist", 6))


@query(f"WITH {pairs_cte('l2', 1.15)} SELECT i AS seq_id, count(*) AS n FROM p GROUP BY i")
def neighbour_counts(spark, d):
    return C.neighbour_counts(pairs_within(points(spark, d), 1.15, "l2"))


@query(f"WITH {E_CTE} SELECT a.id AS i, b.id AS j, round({ABS}, 6) AS dist_l1, round(sqrt({SQ}), 6) AS dist_l2 FROM e a JOIN e b ON b.id < a.id")
def norms_triangular(spark, d):
    return K.triangle(points(spark, d)).select("i", "j", F.round("dist_l1", 6).alias("dist_l1"), F.round("dist_l2", 6).alias("dist_l2"))


def dbscan_cte(metric: str, eps: float, k: str = "") -> str:
    """Recursive CTEs p, d, r and m(id, cluster) with a suffix k."""
    return f"""p{k} AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM e a, e b WHERE {SQ if metric == 'l2' else ABS} <= {eps * eps if metric == 'l2' else eps!r}),
d{k} AS MATERIALIZED (SELECT i, count(*) AS n FROM p{k} GROUP BY i),
r{k}(seed, id) AS (SELECT i, i FROM d{k} WHERE n > {MINPTS} UNION SELECT r{k}.seed, p{k}.j FROM r{k} JOIN d{k} ON d{k}.i = r{k}.id JOIN p{k} ON p{k}.i = r{k}.id WHERE d{k}.n > {MINPTS} OR (d{k}.n = {MINPTS} AND r{k}.id > r{k}.seed)),
m{k} AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY l) - 1 AS cluster FROM (SELECT id, min(seed) AS l FROM r{k} GROUP BY id))"""


DB2, DB1 = (f"WITH RECURSIVE {E_CTE}, {dbscan_cte(m, e)} " for m, e in (("l2", 1.15), ("l1", 7.0)))


@query(DB2 + "SELECT cluster, id AS seq_id FROM m")
def dbscan_l2(spark, d):
    return C.dbscan(points(spark, d), 1.15, MINPTS, "l2")


@query(DB1 + "SELECT cluster, id AS seq_id FROM m")
def dbscan_l1(spark, d):
    return C.dbscan(points(spark, d), 7.0, MINPTS, "l1")


@query(DB2 + "SELECT id AS seq_id FROM e WHERE id NOT IN (SELECT id FROM m)")
def dbscan_outliers(spark, d):
    own = points(spark, d)
    return C.outliers(own, C.dbscan(own, 1.15, MINPTS)).select("seq_id")


@query(DB2 + "SELECT round((SELECT count(*) FROM m) / (SELECT count(*) FROM e), 6) AS coverage")
def dbscan_coverage(spark, d):
    own = points(spark, d)
    return C.coverage(own, C.dbscan(own, 1.15, MINPTS)).select(F.round("coverage", 6).alias("coverage"))


@query(DB2 + "SELECT e.id AS seq_id, coalesce(cluster, -1) AS cluster FROM e LEFT JOIN m USING (id)")
def matrix_line(spark, d):
    own = points(spark, d)
    return L.matrix_line(own, C.dbscan(own, 1.15, MINPTS))


@query(f"WITH RECURSIVE {E_CTE}, {dbscan_cte('l2', 1.15)} SELECT printf('%03d', cluster) AS file, id AS seq_id, '>sequence_' || id || chr(10) || {wrap_sql('s')} AS record FROM m JOIN (SELECT doc_id AS id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM documents) USING (id)")
def cluster_fasta(spark, d):
    return W.cluster_records(seqs(spark, d), C.dbscan(points(spark, d), 1.15, MINPTS))


_LAYERS: dict[tuple[str, str], DataFrame] = {}


def membership(spark: SparkSession, d: str) -> DataFrame:
    """The layers of a session's input: a table in the shared folder that the queries on layers have in common."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LAYERS:
        _LAYERS[key] = saved(C.layers_at(points(spark, d), list(EPSILONS), MINPTS))
    return _LAYERS[key]


def rooted(nodes: DataFrame) -> DataFrame:
    """-1 for no parent."""
    return nodes.withColumn("parent", F.coalesce("parent", F.lit(-1)))


LAYERS = (
    f"WITH RECURSIVE {E_CTE}, "
    + ", ".join(dbscan_cte("l2", e, str(k)) for k, e in enumerate(EPSILONS))
    + ", mm AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT {k} AS layer, cluster, id AS seq_id FROM m{k}" for k in range(len(EPSILONS)))
    + """), sz AS MATERIALIZED (SELECT layer, cluster, count(*) AS n_members FROM mm GROUP BY ALL),
ed AS MATERIALIZED (SELECT x.layer, parent, child, overlap FROM (SELECT u.layer, u.cluster AS parent, l.cluster AS child, count(*) AS overlap FROM mm l JOIN mm u ON u.layer = l.layer + 1 AND u.seq_id = l.seq_id GROUP BY ALL) x
  JOIN sz ON sz.layer = x.layer - 1 AND sz.cluster = x.child WHERE overlap > 0.8 * n_members),
nd AS MATERIALIZED (SELECT sz.layer, sz.cluster, n_members, 'L' || sz.layer || 'C' || sz.cluster || 'N' || n_members AS label, parent FROM sz LEFT JOIN ed ON ed.layer = sz.layer + 1 AND ed.child = sz.cluster),
re(layer, cluster) AS (SELECT layer, cluster FROM nd WHERE layer = 2 AND cluster = 0 UNION SELECT nd.layer, nd.cluster FROM re JOIN nd ON nd.layer = re.layer - 1 AND nd.parent = re.cluster),
tg AS (SELECT vec_id AS seq_id, label AS target FROM embeddings) """
)


@query(LAYERS + "SELECT * FROM mm")
def layer_membership(spark, d):
    return membership(spark, d)


@query(LAYERS + "SELECT * FROM mm")
def split_set_round_trip(spark, d):
    """The layers written as binary split sets, a file each, and read again."""
    path = shared_path(spark)
    split_sets.write_split_sets(membership(spark, d), path)
    return split_sets.read_split_sets(spark, path)


@query(LAYERS + "SELECT * FROM ed")
def layer_edges(spark, d):
    return L.layer_edges(membership(spark, d))


@query(LAYERS + "SELECT layer, cluster, n_members, label, coalesce(parent, -1) AS parent FROM nd")
def tree_nodes(spark, d):
    return rooted(L.tree_nodes(membership(spark, d)))


@query(LAYERS + "SELECT layer, cluster, n_members, label, coalesce(parent, -1) AS parent FROM nd WHERE parent IS NULL AND layer < (SELECT max(layer) FROM mm)")
def tree_orphans(spark, d):
    return rooted(L.orphans(membership(spark, d)))


@query(LAYERS + "SELECT nd.layer, nd.cluster, n_members, label, coalesce(parent, -1) AS parent FROM nd JOIN re ON nd.layer = re.layer AND nd.cluster = re.cluster")
def tree_reachable(spark, d):
    return rooted(L.reachable(membership(spark, d)))


@query(LAYERS + "SELECT layer, dense_rank() OVER (PARTITION BY layer ORDER BY cluster) - 1 AS cluster, seq_id FROM mm JOIN sz USING (layer, cluster) WHERE n_members >= 8")
def min_size_filter(spark, d):
    return L.min_size(membership(spark, d), 8)


@query(LAYERS + "SELECT layer, count(*) AS n_clusters, round(sum(n_members) / (SELECT count(*) FROM e), 6) AS coverage FROM sz GROUP BY layer")
def layer_summary(spark, d):
    n = points(spark, d).agg(F.count("*").alias("n"))
    rows = L.sizes(membership(spark, d)).groupBy("layer").agg(F.count("*").alias("n_clusters"), F.sum("n_members").alias("inside"))
    return rows.join(F.broadcast(n)).select("layer", "n_clusters", F.round(F.col("inside") / F.col("n"), 6).alias("coverage"))


@query(LAYERS + "SELECT layer, n FROM (SELECT layer, n, min(n) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM (SELECT layer, count(*) AS n FROM sz GROUP BY layer)) WHERE w IS NULL OR n < w".replace("SELECT layer, n FROM", "SELECT layer, n AS n_clusters FROM"))
def layer_selection(spark, d):
    return L.decreasing_layers(L.sizes(membership(spark, d)).groupBy("layer").agg(F.count("*").alias("n_clusters")))


def branch_sql(volume: str) -> str:
    return LAYERS + f"SELECT layer, round(dn - lead(dn) OVER (ORDER BY layer), 6) AS length FROM (SELECT layer, {float(MINPTS)} / ({volume}) AS dn FROM (SELECT DISTINCT layer, CASE layer {' '.join(f'WHEN {k} THEN {e}' for k, e in enumerate(EPSILONS))} END AS epsilon FROM mm))"


def branches(spark: SparkSession, d: str, kind: int) -> DataFrame:
    eps = F.element_at(F.array(*[F.lit(e) for e in EPSILONS]), F.col("layer") + 1).alias("epsilon")
    rows = membership(spark, d).select("layer").distinct().select("layer", eps)
    return L.branch_lengths(rows, 2, MINPTS, kind).select("layer", F.round("length", 6).alias("length"))


@query(branch_sql("power(epsilon, 2)"))
def branch_lengths_cube(spark, d):
    return branches(spark, d, 1)


@query(branch_sql(f"power(epsilon, 2) * {math.pi}"))
def branch_lengths_sphere(spark, d):
    return branches(spark, d, 2)


#: Texts of the clusters of the first and of the second layer.
NEWICK = """, t0 AS (SELECT cluster, parent, label || ':1.000000' AS t FROM nd WHERE layer = 0),
t1 AS (SELECT nd.cluster, nd.parent, coalesce('(' || k.t || ')', '') || label || ':1.000000' AS t FROM nd LEFT JOIN (SELECT parent, string_agg(t, ',' ORDER BY cluster DESC) AS t FROM t0 WHERE parent IS NOT NULL GROUP BY parent) k ON k.parent = nd.cluster WHERE layer = 1)
SELECT coalesce('(' || string_agg(t, ',' ORDER BY cluster DESC) || ')', '') || 'L2C0;' AS newick FROM t1 WHERE parent = 0"""


@query(LAYERS + NEWICK)
def newick(spark, d):
    return L.newick_table(membership(spark, d))


MASKS = "WITH m AS (SELECT doc_id AS seq_id, coalesce(quality = 1, false) AS a, coalesce(toxic = 1, false) AS b FROM labels) "


@query(MASKS + "SELECT seq_id FROM m WHERE a OR b")
def mask_or(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("seq_id"), "quality", "toxic")
    return L.unpacked_mask(L.mask_or(*[L.packed_mask(rows.select("seq_id", F.col(c).alias("mask"))) for c in ("quality", "toxic")])).select("seq_id")


@query(MASKS + "SELECT seq_id FROM m WHERE a AND b")
def mask_and(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("seq_id"), "quality", "toxic")
    return L.unpacked_mask(L.mask_and(*[L.packed_mask(rows.select("seq_id", F.col(c).alias("mask"))) for c in ("quality", "toxic")])).select("seq_id")


@query("SELECT string_agg(n::VARCHAR, chr(9) ORDER BY n) AS line FROM range((SELECT count(*) FROM embeddings)) t(n)")
def matrix_annotation(spark, d):
    return L.matrix_annotation(points(spark, d))


@query()
def adaptive_layers(spark, d):
    return C.adaptive_dbscan(points(spark, d), 1.13, 0.01, MINPTS)[1]


@query("SELECT label AS cluster, vec_id AS seq_id FROM embeddings")
def split_set_from_label(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("seq_id"), F.col("label").cast("string").alias("annotation"))
    unique = own.select("annotation").distinct().select(F.col("annotation").cast("int").alias("cluster"), "annotation")
    return L.cluster_of_annotation(own, unique)


OV = LAYERS.rstrip() + ", ov AS (SELECT layer, cluster, target, count(*) AS overlap FROM mm JOIN tg USING (seq_id) GROUP BY ALL) "


@query(OV + "SELECT * FROM ov")
def cluster_overlaps(spark, d):
    return L.overlaps(membership(spark, d), target(spark, d))


@query(
    OV.rstrip()
    + """, im AS (SELECT ov.layer, ov.cluster, sum(CASE WHEN overlap > n_members // 2 THEN n_members - overlap ELSE overlap END / n_members) AS odd FROM ov JOIN nd ON nd.layer = ov.layer AND nd.cluster = ov.cluster JOIN re ON re.layer = ov.layer AND re.cluster = ov.cluster WHERE overlap <> n_members GROUP BY ALL),
im2 AS (SELECT layer, sum(odd) AS odd, count(*) AS impure FROM im GROUP BY layer), n AS (SELECT layer, count(*) AS n FROM sz GROUP BY layer), nt AS (SELECT count(DISTINCT target) AS nt FROM tg)
SELECT layer, round(coalesce(odd / impure, 0), 6) AS purity, round(abs(n - nt) / nt, 6) AS cluster_factor, round(coalesce(impure, 0) / n, 6) AS impure_fraction FROM n LEFT JOIN im2 USING (layer), nt"""
)
def purity(spark, d):
    return L.purity(membership(spark, d), target(spark, d)).select("layer", *[F.round(c, 6).alias(c) for c in ("purity", "cluster_factor", "impure_fraction")])


def recovery(spark: SparkSession, d: str, n: int) -> DataFrame:
    return L.partitions_found(membership(spark, d), n, 10, 0.1)


@query(LAYERS + ", cn AS (SELECT count(*) // 10 AS size FROM e), fit AS (SELECT layer, cluster FROM sz, cn WHERE abs(n_members - size) < 0.9 * size) SELECT DISTINCT part AS partition_no FROM (SELECT layer, cluster, seq_id // size AS part, count(*) AS k, any_value(size) AS size FROM mm JOIN fit USING (layer, cluster), cn GROUP BY ALL) WHERE k > size - 0.9 * size")
def partition_recovery(spark, d):
    return recovery(spark, d, points(spark, d).count())


@query(LAYERS + ", q AS (SELECT vec_id AS seq_id FROM embeddings WHERE label = 3) SELECT layer, cluster, 'stroke:#00FF00 I ' || label AS line FROM nd WHERE EXISTS (SELECT 1 FROM mm JOIN q USING (seq_id) WHERE mm.layer = nd.layer AND mm.cluster = nd.cluster)")
def tree_map_sequence(spark, d):
    return L.tree_map_sequence(membership(spark, d), target(spark, d).where("target = 3"), "#00FF00")


@query(LAYERS + ", q AS (SELECT vec_id AS seq_id FROM embeddings WHERE label = 3) SELECT layer, cluster, count(*) AS n FROM mm JOIN q USING (seq_id) GROUP BY ALL")
def find_sequence(spark, d):
    return L.find_sequence(membership(spark, d), target(spark, d).where("target = 3"))


@query(
    OV.rstrip()
    + """, nt AS (SELECT target, count(*) AS n_target FROM tg GROUP BY target), pk AS (SELECT * FROM (VALUES (0, 16, 32, 64), (4, 200, 100, 0)) v(target, r, g, b)),
x AS (SELECT nd.layer, nd.cluster, pk.target, r, g, b, label, overlap, n_target FROM nd CROSS JOIN pk JOIN nt ON nt.target = pk.target LEFT JOIN ov ON ov.layer = nd.layer AND ov.cluster = nd.cluster AND ov.target = pk.target)
SELECT layer, cluster, target, 'stroke:' || CASE WHEN overlap IS NULL THEN '#FFFFFF' ELSE upper(printf('#%02x%02x%02x', 255 - trunc((255 - r) * (overlap / n_target))::INT, 255 - trunc((255 - g) * (overlap / n_target))::INT, 255 - trunc((255 - b) * (overlap / n_target))::INT)) END || ' I ' || label AS line FROM x"""
)
def tree_map_split_set(spark, d):
    return L.tree_map_split_set(membership(spark, d), target(spark, d), [(1, "#102040"), (5, "#C86400")], 1)


@query("SELECT dim, min(v) AS lo, max(v) AS hi FROM (SELECT unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY dim")
def minmax_dim(spark, d):
    return P.min_max(points(spark, d))


def grid_sql(dims: int) -> str:
    xs = ["x", "y", "z"][:dims]
    cell = ", ".join(f"floor((v[{k + 1}] - lo{k}) / 0.05)::INT AS {x}" for k, x in enumerate(xs))
    lo = ", ".join(f"min(v[{k + 1}]) AS lo{k}, max(v[{k + 1}]) AS hi{k}" for k in range(dims))
    full = ", ".join(f"unnest(range(floor((hi{k} - lo{k}) / 0.05)::INT + 1)) AS {x}" for k, x in enumerate(xs))
    grids = " CROSS JOIN ".join(f"(SELECT {f} FROM b)" for f in full.split(", "))
    return f"WITH {E_CTE}, b AS (SELECT {lo} FROM e), c AS (SELECT {', '.join(xs)}, count(*) AS n FROM (SELECT {cell} FROM e, b) GROUP BY ALL), g AS (SELECT {', '.join(xs)}, coalesce(n, 0) AS n FROM (SELECT * FROM {grids}) LEFT JOIN c USING ({', '.join(xs)})) "


@query(grid_sql(2) + "SELECT * FROM g")
def density_grid(spark, d):
    return P.density_grid(points(spark, d), 0.05)


@query(grid_sql(3) + "SELECT * FROM g")
def density_grid_3d(spark, d):
    return P.density_grid(points(spark, d), 0.05, 3)


@query(grid_sql(2) + "SELECT x, y, n, least(255, trunc(n * 255.0::DOUBLE / greatest((SELECT max(n) FROM g), 1))::INT) AS level FROM g")
def density_scaled(spark, d):
    return P.density_scaled(P.density_grid(points(spark, d), 0.05))


@query(grid_sql(3) + "SELECT z, x, y, least(255, trunc(n * 255.0::DOUBLE / greatest((SELECT max(n) FROM g), 1))::INT) AS level FROM g")
def density_png_round_trip(spark, d):
    """A picture of every slice of the grid, written by the tasks and read again."""
    path = shared_path(spark)
    pictures.write_pictures(saved(P.density_scaled(P.density_grid(points(spark, d), 0.05, 3))), path)
    return pictures.read_pictures(spark, path)


PX = f"WITH {E_CTE}, b AS (SELECT min(v[1]) AS x0, max(v[1]) AS x1, min(v[2]) AS y0, max(v[2]) AS y1 FROM e), px AS (SELECT id AS seq_id, trunc(abs(v[1] - x0) / ((x1 - x0) / 399))::INT AS px, trunc(abs(v[2] - y0) / ((y1 - y0) / 399))::INT AS py FROM e, b) "


@query(PX + "SELECT seq_id FROM px WHERE px BETWEEN 100 AND 300 AND py BETWEEN 50 AND 250")
def density_rect_select(spark, d):
    return P.rectangle(points(spark, d), 0, 1, (300, 50), (100, 250))


@query(PX + "SELECT DISTINCT px, py FROM px")
def raster(spark, d):
    return P.raster(points(spark, d), 0, 1)


@query("SELECT dim, round(avg(v), 9) AS mean FROM (SELECT unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY dim")
def column_means(spark, d):
    return P.column_means(points(spark, d)).select("dim", F.round("mean", 9).alias("mean"))


@query("WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS k FROM embeddings) SELECT p.k AS a, q.k AS b, round(covar_pop(p.v, q.v), 9) AS cov FROM x p JOIN x q ON p.vec_id = q.vec_id AND p.k <= q.k GROUP BY ALL")
def covariance(spark, d):
    return P.covariance(points(spark, d)).select("a", "b", F.round("cov", 9).alias("cov"))


@query("WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS k FROM embeddings), n AS (SELECT k, sqrt(sum(v * v)) AS norm FROM x GROUP BY k) SELECT p.k AS a, q.k AS b, round(sum(p.v * q.v) / any_value(n.norm) / any_value(m.norm), 9) AS correlation FROM x p JOIN x q ON p.vec_id = q.vec_id AND p.k <= q.k JOIN n ON n.k = p.k JOIN n m ON m.k = q.k GROUP BY ALL")
def feature_correlation(spark, d):
    return P.feature_correlation(points(spark, d)).select("a", "b", F.round("correlation", 9).alias("correlation"))


@query("WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(len(embedding))) AS k FROM embeddings), c AS (SELECT p.k AS a, q.k AS b, covar_pop(p.v, q.v) AS cov FROM x p JOIN x q ON p.vec_id = q.vec_id GROUP BY ALL) SELECT count(*) FILTER (a = b) AS n_values, round(sum(cov) FILTER (a = b), 6) AS total, round(sum(cov * cov), 6) AS squares FROM c")
def eigenvalue_sums(spark, d):
    """Eigenvalues sum to the trace of the covariance, and their squares to its squared norm."""
    values, _ = P.principal_components(points(spark, d), 1)
    rows = spark.createDataFrame([(float(v),) for v in values], "value double")
    return rows.agg(F.count("*").alias("n_values"), F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("squares"))


@query()
def pca_projection_abs(spark, d):
    return P.pca(points(spark, d), 3).select("seq_id", F.transform("values", F.abs).alias("values"))


@query("SELECT user_id AS cluster, count(*) AS n FROM events GROUP BY user_id")
def swarm_line_sizes(spark, d):
    """Lines of swarm tokens made from events, parsed back: one token an event."""
    own = table(spark, d, "events").select(F.col("user_id").cast("int").alias("cluster"), F.format_string("sequence_%d_mutiplicity_1", "event_id").alias("value"))
    ids = table(spark, d, "events").select(F.col("event_id").alias("seq_id"), F.col("event_id").cast("string").alias("seq"))
    return R.swarm_clusters(own, ids).groupBy("cluster").agg(F.count("*").alias("n"))


@query(
    "WITH own AS (SELECT p_partkey AS seq_id, regexp_replace(upper(p_name), '[^ACGT]', '', 'g') AS seq, p_size::INT AS cluster FROM part), "
    "named AS (SELECT seq, min(cluster) AS cluster FROM own GROUP BY seq) SELECT named.cluster, seq_id FROM own JOIN named USING (seq)"
)
def swarm_clusters(spark, d):
    """Swarm tokens of the parts of a size: parts of equal letters follow the first line that names one of them."""
    own = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.regexp_replace(F.upper("p_name"), "[^ACGT]", "").alias("seq"), F.col("p_size").cast("int").alias("cluster"))
    return R.swarm_clusters(own.select("cluster", F.format_string("sequence_%d_mutiplicity_1", "seq_id").alias("value")), own.select("seq_id", "seq"))
