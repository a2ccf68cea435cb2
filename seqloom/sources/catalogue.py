"""The work catalogue: which targets, tasks and split each dataset is probed with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The twenty most frequent micro-RNAs.
MIRNAS = (
    "hsa-miR-92a-3p", "hsa-miR-122-5p", "hsa-miR-21-5p", "hsa-miR-186-5p", "hsa-miR-320a-3p",
    "hsa-miR-17-5p", "hsa-miR-8485", "hsa-miR-484", "hsa-miR-20a-5p", "hsa-miR-19b-3p",
    "hsa-miR-26a-5p", "hsa-miR-615-3p", "hsa-miR-16-5p", "hsa-miR-194-5p", "hsa-miR-30c-5p",
    "hsa-miR-19a-3p", "hsa-miR-193b-3p", "hsa-miR-93-5p", "hsa-miR-103a-3p", "hsa-let-7b-5p",
)
# The twenty binding proteins probed per cell line.
BINDING_K562 = (
    "YBX3", "UCHL5", "ZNF622", "DDX3X", "LIN28B", "PUM2", "PABPC4", "DDX24", "IGF2BP1", "IGF2BP2",
    "RBM15", "FAM120A", "PUM1", "SND1", "DDX6", "METAP2", "FXR2", "PCBP1", "TIA1", "FMR1",
)
BINDING_HEPG2 = (
    "PPIG", "DDX3X", "LARP4", "LIN28B", "G3BP1", "NCBP2", "IGF2BP1", "AKAP1", "PCBP2", "PABPN1",
    "SND1", "UCHL5", "DDX55", "FXR2", "EIF3H", "IGF2BP3", "SRSF1", "HLTF", "LSM11", "PRPF4",
)


def _names(prefix: str, names) -> list[str]:
    return [prefix + n for n in names]


# Dataset, species, task, targets, usual split.
DATASETS = [
    ("eclip-binding-k562", "human", "classification", _names("target_", BINDING_K562), "homology"),
    ("eclip-binding-hepg2", "human", "classification", _names("target_", BINDING_HEPG2), "homology"),
    ("go-bp", "human", "multilabel", ["target"], "homology"),
    ("go-cc", "human", "multilabel", ["target"], "homology"),
    ("go-mf", "human", "multilabel", ["target"], "homology"),
    ("rnahl-human", "human", "reg_ridge", ["target"], "homology"),
    ("rnahl-mouse", "mouse", "reg_ridge", ["target"], "homology"),
    ("rna-loc-fazal", "human", "multilabel", ["target"], "homology"),
    ("rna-lifecycle-ietswaart", "human", "multilabel", ["target"], "homology"),
    ("prot-loc", "human", "multilabel", ["target"], "homology"),
    ("mirna-target", "human", "classification", _names("target_", MIRNAS), "homology"),
    ("mrl-hl-lbkwk", "synthetic", "reg_ridge", ["target_in_cell_half_life", "target_ribosome_load"], "default"),
    ("mrl-sugimoto", "human", "reg_ridge", ["target"], "homology"),
    (
        "mrl-sample-egfp",
        "synthetic",
        "reg_ridge",
        ["target_mrl_egfp_m1pseudo", "target_mrl_egfp_pseudo", "target_mrl_egfp_unmod"],
        "default",
    ),
    ("mrl-sample-mcherry", "synthetic", "reg_ridge", ["target_mrl_mcherry"], "default"),
    ("mrl-sample-designed", "synthetic", "reg_ridge", ["target_mrl_designed"], "default"),
    ("mrl-sample-varying", "synthetic", "reg_ridge", ["target_mrl_varying_length"], "default"),
    ("translation-efficiency-human", "human", "reg_ridge", ["target"], "homology"),
    ("translation-efficiency-mouse", "mouse", "reg_ridge", ["target"], "homology"),
    ("utr-variants-bohn-utr5", "human", "classification", ["target"], "default"),
    ("utr-variants-bohn-utr3", "human", "classification", ["target"], "default"),
    ("vep-traitgym-complex", "human", "classification", ["target"], "default"),
    ("vep-traitgym-mendelian", "human", "classification", ["target"], "default"),
]

SCHEMA = "dataset string, species string, task array<string>, target array<string>, split_type string"


def datasets(spark: SparkSession) -> DataFrame:
    """One row per dataset, its tasks and targets as parallel arrays."""
    rows = [(d, sp, [task] * len(targets), targets, split) for d, sp, task, targets, split in DATASETS]
    return spark.createDataFrame(rows, SCHEMA)


def task_catalog(catalogue: DataFrame) -> DataFrame:
    """One row per (dataset, target) with its task and usual split."""
    rest = [c for c in catalogue.columns if c not in ("task", "target")]
    pairs = F.explode(F.arrays_zip("task", "target")).alias("pair")
    return catalogue.select(*rest, pairs).select(*rest, "pair.task", "pair.target")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The processed table of a catalogued dataset under `root`."""
    if name not in {d[0] for d in DATASETS}:
        raise KeyError(f"unknown dataset: {name}")
    return spark.read.parquet(f"{root}/{name}/data_df.parquet")
