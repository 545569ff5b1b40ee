"""Table functions in SQL, packed masks, and the Newick text with its options."""

import pytest

from helixframe.functions import tables
from helixframe.operators import layers as L
from helixframe.operators import sequences as O


def seqs(spark):
    rows = ["ACGTACGTN", "TCTAGATCTAGAA", "AATCTAGA", "", "A", None, "NACNN", "xTCTAGAx"]
    return spark.createDataFrame(list(enumerate(rows)), "seq_id long, seq string")


def test_table_functions_equal_the_operators(spark):
    tables.register(spark)
    own = seqs(spark)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(spark.sql("SELECT seq_id, kmer, cnt FROM {own}, LATERAL fasta_kmers(seq, 3)", own=own)) == rows(O.kmer_counts(own, 3))
    for enzyme in ("XbaI", "XmnI"):
        assert rows(spark.sql(f"SELECT seq_id, fragment, fragment_seq, fragment_len FROM {{own}}, LATERAL digest(seq, '{enzyme}')", own=own)) == rows(O.digest(own, enzyme))
    assert rows(spark.sql("SELECT seq_id, k, expanded FROM {own}, LATERAL expand_n(seq)", own=own)) == rows(O.n_expanded(own.where("seq is not null")))


def test_packed_masks(spark):
    draw = [0, 1, -1, 32767, 32768, 32769, -32768, -40000, 5_000_000_000, 7, 8]
    a, b = set(draw[::2]), set(draw[::3])
    pack = lambda ids: L.packed_mask(spark.createDataFrame([(i, int(i in ids)) for i in draw], "seq_id long, mask int"))
    ids = lambda df: sorted(r.seq_id for r in L.unpacked_mask(df).collect())
    assert ids(pack(a)) == sorted(a)
    assert ids(L.mask_or(pack(a), pack(b))) == sorted(a | b)
    assert ids(L.mask_and(pack(a), pack(b))) == sorted(a & b)
    assert L.packed_mask(spark.createDataFrame([], "seq_id long, mask int")).count() == 0


def test_newick_options(spark):
    tree = [(0, c, s) for c, own in enumerate((range(6), range(6, 9), range(9, 14))) for s in own] + [(1, c, s) for c, own in enumerate((range(9), range(9, 14))) for s in own] + [(2, 0, s) for s in range(14)]
    m = spark.createDataFrame(tree, "layer int, cluster int, seq_id long")
    text = lambda df: df.first().newick
    assert text(L.newick_program(m)) == "((L0C2N5:1.000000)L1C1N5:1.000000,(L0C1N3:1.000000,L0C0N6:1.000000)L1C0N9:1.000000)L2C0;"
    assert text(L.newick_program(m, least=5)) == "((L0C1N5:1.000000)L1C1N5:1.000000,(L0C0N6:1.000000)L1C0N9:1.000000)L2C0;"
    layers = spark.createDataFrame([(0, 0.5), (1, 1.0), (2, 2.0)], "layer int, epsilon double")
    for mode in (1, 2):
        length = {r.layer: r.length for r in L.branch_lengths(layers, 2, 3, mode).collect()}
        wanted = f"((L0C2N5:{length[0]:f})L1C1N5:{length[1]:f},(L0C1N3:{length[0]:f},L0C0N6:{length[0]:f})L1C0N9:{length[1]:f})L2C0;"
        assert text(L.newick_program(m, layers, 0, mode, 2, 3)) == wanted
    with pytest.raises(ValueError):
        L.newick_program(m, mode=1)
    assert text(L.newick_table(m.limit(0))) == ";"


def test_matrix_annotation(spark):
    assert L.matrix_annotation(spark.range(4)).first().line == "0\t1\t2\t3" and L.matrix_annotation(spark.range(0)).first().line == ""
