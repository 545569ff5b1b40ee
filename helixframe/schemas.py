"""Schemas of the tables that the operators read and write."""

SEQUENCES = "seq_id long, seq string, seq_len int"
VECTORS = "seq_id long, values array<double>"
KMER_COUNTS = "seq_id long, kmer string, kmer_idx int, cnt int"
MEMBERSHIP = "layer int, cluster int, seq_id long"
LAYERS = "layer int, epsilon double, epsilon_printed double, n_clusters int, coverage double"
EDGES = "layer int, parent int, child int, overlap long"
PAIRS = "i long, j long, dist double"
MASK = "seq_id long, mask int"
ANNOTATION = "seq_id long, annotation string"
