import random

from helixframe.functions import distance
from helixframe.functions import geometry as G
from helixframe.functions import sequences as S
from helixframe.operators import sequences as O
from pyspark.sql import functions as F

TEST2 = ["AAGAAGCTTAC", "TCAGGGAAAGCTTA"]
TEST3 = ["TCAGATAACT", "TCAGAAAACT"]


def seqs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq_id long, seq string")


def test_kmer_order(spark):
    got = [r.kmer for r in S.dna_kmer_universe(spark, 2).orderBy("kmer_idx").collect()]
    assert got[:6] == ["AA", "CA", "GA", "TA", "AC", "CC"] and len(got) == 16
    protein = [r.kmer for r in S.protein_kmer_universe(spark, 2).orderBy("kmer_idx").collect()]
    assert protein == sorted(protein) and len(protein) == 400


def test_last_window_is_not_counted(spark):
    rows = O.kmer_counts(seqs(spark, ["AACT", "AC", "A", "", "ANCGA"]), 2).collect()
    assert sorted((r.seq_id, r.kmer, r.cnt) for r in rows) == [(0, "AA", 1), (0, "AC", 1), (4, "CG", 1)]
    rows = O.kmer_counts(seqs(spark, ["AC"]), 2, include_last_window=True).collect()
    assert [(r.kmer, r.cnt) for r in rows] == [("AC", 1)]


def test_dense_counts_have_zero_rows(spark):
    got = {r.seq_id: r.counts for r in O.kmer_dense(seqs(spark, ["AAAC", "A"]), 1).collect()}
    assert got == {0: [3, 0, 0, 0], 1: [0, 0, 0, 0]}


def test_digest(spark):
    rows = O.digest(seqs(spark, ["TCAGGGAAAGCTTA", "AAGCTT", "GGTCTAGACCC", "ACG"]), "HindIII").orderBy("seq_id", "fragment").collect()
    assert [(r.seq_id, r.fragment_seq) for r in rows] == [(0, "TCAGGGAA"), (0, "AGCTTA"), (1, "AAGCTT"), (2, "GGTCTAGACCC"), (3, "ACG")]
    rows = O.digest(seqs(spark, ["GGTCTAGACCC"]), "XbaI").orderBy("fragment").collect()
    assert [r.fragment_seq for r in rows] == ["GGT", "CTAGACCC"]
    rows = O.digest(seqs(spark, ["CGAACCGGTTCAA"]), "XmnI").orderBy("fragment").collect()
    assert "".join(r.fragment_seq for r in rows) == "CGAACCGGTTCAA" and len(rows) == 2


def test_consensus_ties_shares_and_carry(spark):
    rows = O.consensus(seqs(spark, ["ACN", "CCN", "AC"])).orderBy("pos").collect()
    assert [r.base for r in rows] == ["A", "C", "C"]
    assert rows[0].f_a == 2 / 3 and rows[2].f_a == 0
    assert O.consensus_string(O.consensus(seqs(spark, ["ACN", "CCN", "AC"]))).first()[0] == "ACC"


def test_multiplicity_and_fasta(spark):
    rows = O.multiplicity_fasta(seqs(spark, ["ACGT", "GG", "ACGT"])).orderBy("multiplicity", "seq_id").collect()
    assert [r.record for r in rows] == [">sequence_1_mutiplicity_1\nGG", ">sequence_0_mutiplicity_2\nACGT"]
    long = O.fasta_text(seqs(spark, ["A" * 50, "A" * 51])).orderBy("seq_id").collect()
    assert [r.record for r in long] == [">sequence_0\n" + "A" * 50, ">sequence_1\n" + "A" * 50 + "\nA"]


def test_masks(spark):
    mask = spark.createDataFrame([(0, 1), (1, 2)], "seq_id long, mask int")
    rows = O.reverse_complement_masked(seqs(spark, ["AACN", "AACN", "AACN"]), mask).orderBy("seq_id").collect()
    assert [r.seq for r in rows] == ["NGTT", "AACN", "AACN"]


def test_expansion_of_n(spark):
    rows = O.n_expanded(seqs(spark, ["ANT", "AC"])).orderBy("seq_id", "k").collect()
    assert [r.seq for r in rows] == ["AAT", "ACT", "AGT", "ATT", "AC"]


def test_expansion_of_many_n(spark):
    rows = O.n_expanded(seqs(spark, ["N" * 8 + "A"]))
    assert rows.count() == 4**8 == rows.select("seq").distinct().count()
    assert rows.where("k = 5").first().seq == "CCAAAAAAA"


def test_windows_and_cuts_take_time_in_proportion(spark):
    """Eight times the letters: not nearly sixty-four times the time."""
    import time

    def took(n):
        own = seqs(spark, ["ACGTTCTAGAAC" * n] * 4)
        began = time.time()
        assert O.kmer_counts(own, 2).agg(F.sum("cnt")).first()[0] == 4 * (12 * n - 2) and O.digest(own, "XbaI").count() == 4 * (n + 1)
        return time.time() - began

    took(100)
    assert took(16_000) < 24 * max(0.4, took(2_000))


def test_length_window_and_colours(spark):
    assert [r.seq for r in O.length_window(seqs(spark, ["A", "AA", "AAA"]), 2, 0, 5).orderBy("seq_id").collect()] == ["A", "AA"]
    row = spark.range(1).select(G.faded(F.lit("#102040"), F.lit(0.5)).alias("c"), G.parse_node_label(F.lit("L1C2N30")).alias("n")).first()
    assert row.c == "#888FA0".replace("8F", "90") or row.c == "#8890A0"
    assert tuple(row.n) == (1, 2, 30)


def test_values_are_carried_over_blocks(spark):
    values = [None, None, "a", None, None, None, None, "b", None, "c", None, None, None, None, None, None, "d"]
    rows = spark.createDataFrame([(i, v, i) for i, v in enumerate(values)], "pos int, own string, more int")
    wanted, last = [], None
    for v in values:
        last = v or last
        wanted.append(last)
    for size in (1, 3, 100):
        got = O.carried(rows.repartition(3), "pos", "own", size).orderBy("pos").collect()
        assert [r.own for r in got] == wanted and got[0].more == 0
    gaps = spark.createDataFrame([(0, "ACNNG"), (1, "ACNN")], "seq_id long, seq string")
    assert O.consensus_string(O.consensus(gaps)).first()[0] == "ACCCG"


def test_unique_records_are_ranked(spark):
    """Ascending multiplicity, then id: the fixture's order."""
    rows = ["TCAGAAGCTTA", "TCAGGGAAAAGCTT", "TCAGAAGCTTA", "AAGCTTTCAGAA"]
    got = O.multiplicity_fasta(spark.createDataFrame(list(enumerate(rows)), "seq_id long, seq string")).orderBy("rank").collect()
    assert [(r.rank, r.seq_id, r.multiplicity) for r in got] == [(0, 1, 1), (1, 3, 1), (2, 0, 2)]
    assert got[2].record == ">sequence_0_mutiplicity_2\nTCAGAAGCTTA"
    assert O.multiplicity_fasta(spark.createDataFrame([], "seq_id long, seq string")).count() == 0


def plain_alignment(a, b):
    """4 times the longer length less the best local score, cell by cell."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(max(0, row[k] + (4 if x == y else -4), row[k + 1] - 3, new[k] - 3))
        row, best = new, max(best, *new)
    return 4 * max(len(a), len(b)) - best


def test_textbook_alignment_and_the_sql_function(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("ACGT", k=rng.randrange(1, 30))) for _ in range(40)]
    a, b = words[:20], words[20:]
    assert distance.alignment_distances(a, b, textbook=True).tolist() == [plain_alignment(x, y) for x, y in zip(a, b, strict=True)]
    assert distance.alignment_distances(["ACGT", "A"], ["ACGT", "C"], textbook=True).tolist() == [0, 4]
    distance.register_sw_distance(spark)
    spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string").createOrReplaceTempView("sw_pairs")
    got = {(r.a, r.b): r.d for r in spark.sql("SELECT a, b, sw_distance(a, b) d FROM sw_pairs").collect()}
    # the compared operands are the sequences without their first letter and with an end mark
    for x, y in zip(a, b, strict=True):
        x1, y1 = x[1:] + "\0", y[1:] + "\0"
        assert got[(x, y)] == 4 * max(len(x), len(y)) - (4 * max(len(x1), len(y1)) - plain_alignment(x1, y1))
