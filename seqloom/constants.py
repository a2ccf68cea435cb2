"""Texts, lists and numbers that results depend on."""

# Reporter constructs. Primer before the insert, reporter sequence after it.
PRIMER = "GGGACATCGTAGAGAGTCGTACTTA"
EGFP = (
    "ATGGGCGAATTAAGTAAGGGCGAGGAGCTGTTCACCGGGGTGGTGCCCATCCTGGTCGAGCTGGACGGCGACGTAAACGG"
    "CCACAAGTTCAGCGTGTCCGGCGAGGGCGAGGGCGATGCCACCTACGGCAAGCTGACCCTGAAGTTCATCTGCACCACCG"
    "GCAAGCTGCCCGTGCCCTGGCCCACCCTCGTGACCACCCTGACCTACGGCGTGCAGTGCTTCAGCCGCTACCCCGACCAC"
    "ATGAAGCAGCACGACTTCTTCAAGTCCGCCATGCCCGAAGGCTACGTCCAGGAGCGCACCATCTTCTTCAAGGACGACGG"
    "CAACTACAAGACCCGCGCCGAGGTGAAGTTCGAGGGCGACACCCTGGTGAACCGCATCGAGCTGAAGGGCATCGACTTCA"
    "AGGAGGACGGCAACATCCTGGGGCACAAGCTGGAGTACAACTACAACAGCCACAACGTCTATATCATGGCCGACAAGCAG"
    "AAGAACGGCATCAAGGTGAACTTCAAGATCCGCCACAACATCGAGGACGGCAGCGTGCAGCTCGCCGACCACTACCAGCA"
    "GAACACCCCCATCGGCGACGGCCCCGTGCTGCTGCCCGACAACCACTACCTGAGCACCCAGTCCAAGCTGAGCAAAGACC"
    "CCAACGAGAAGCGCGATCACATGGTCCTGCTGGAGTTCGTGACCGCCGCCGGGATCACTCTCGGCATGGACGAGCTGTAC"
    "AAGTTCGAATAAAGCTAGCGCCTCGACTGTGCCTTCTAGTTGCCAGCCATCTGTTGTTTG"
)
MCHERRY = (
    "ATGCCTCCCGAGAAGAAGATCAAGAGCGTGAGCAAGGGCGAGGAGGATAACATGGCCATCATCAAGGAGTTCATGCGCTT"
    "CAAGGTGCACATGGAGGGCTCCGTGAACGGCCACGAGTTCGAGATCGAGGGCGAGGGCGAGGGCCGCCCCTACGAGGGCA"
    "CCCAGACCGCCAAGCTGAAGGTGACCAAGGGTGGCCCCCTGCCCTTCGCCTGGGACATCCTGTCCCCTCAGTTCATGTAC"
    "GGCTCCAAGGCCTACGTGAAGCACCCCGCCGACATCCCCGACTACTTGAAGCTGTCCTTCCCCGAGGGCTTCAAGTGGGA"
    "GCGCGTGATGAACTTCGAGGACGGCGGCGTGGTGACCGTGACCCAGGACTCCTCCCTGCAGGACGGCGAGTTCATCTACA"
    "AGGTGAAGCTGCGCGGCACCAACTTCCCCTCCGACGGCCCCGTAATGCAGAAGAAGACCATGGGCTGGGAGGCCTCCTCC"
    "GAGCGGATGTACCCCGAGGACGGCGCCCTGAAGGGCGAGATCAAGCAGAGGCTGAAGCTGAAGGACGGCGGCCACTACGA"
    "CGCTGAGGTCAAGACCACCTACAAGGCCAAGAAGCCCGTGCAGCTGCCCGGCGCCTACAACGTCAACATCAAGTTGGACA"
    "TCACCTCCCACAACGAGGACTACACCATCGTGGAACAGTACGAACGCGCCGAGGGCCGCCACTCCACCGGCGGCATGGAC"
    "GAGCTGTACAAGTCTTAACGCCTCGACTGTGCCTTCTAGTTGCCAGCCATCTGTTGTTTG"
)
# Codons of the reading frame by reporter.
EGFP_CODONS = 244
MCHERRY_CODONS = 246

# Allowed bases at the last three positions before the start codon.
KOZAK_STRONG = ("AG", "CA", "CGA")
KOZAK_WEAK = ("T", "G", "TC")

CODON_REGEX = "(?s).{3}"

# Random seeds of a full run.
SEEDS = (2541, 413, 411, 412, 2547, 321, 421, 311, 2516, 2515)

# Train, validation and test shares.
DEFAULT_RATIOS = (0.7, 0.15, 0.15)

# Ridge penalties tried.
RIDGE_ALPHAS = (1e-3, 1e-2, 1e-1, 1.0, 10.0)
# Fixed value: penalty of the fallback ridge.
RIDGE_FALLBACK_ALPHA = 1e-3

# Fixed value: share of a compartment from which a transcript counts as localised there.
LOCALISED_SHARE = 0.125

# Fixed value: rank of a transcript without a principality level.
NO_PRINCIPALITY = 100

# Columns every dataset may have, in no particular order.
INVARIANT_COLUMNS = ("sequence", "gene", "chromosome", "cds", "splice")

# Names of the split types.
SPLIT_TYPES = ("default", "homology", "kmer", "chromosome", "hard-kmer")
