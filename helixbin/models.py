"""Feature models as objects: ``fit(bank)`` learns what a model needs, ``transform(bank)`` gives ``chunk_id, features``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.dna import check_mask
from .operators import coding, contig2vec, coverage, ind, kmer


class Model:
    """``fit`` returns the model; ``fit_transform`` does both."""

    def fit(self, bank: DataFrame) -> Model:
        return self

    def transform(self, bank: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, bank: DataFrame) -> DataFrame:
        return self.fit(bank).transform(bank)


@dataclass
class KmerModel(Model):
    """Counts of the canonical k-mers of a mask, over the full vocabulary."""

    mask: str = "1111"

    def __post_init__(self) -> None:
        check_mask(self.mask)

    def transform(self, bank: DataFrame) -> DataFrame:
        return kmer.dense(bank, self.mask)


@dataclass
class DistanceModel(Model):
    """Inter-nucleotide distances and runs, ``k`` values each."""

    k: int = 15

    def transform(self, bank: DataFrame) -> DataFrame:
        return ind.vectors(bank, self.k)


@dataclass
class WordVectorModel(Model):
    """Sentence vectors of k-mer words; ``fit`` trains word vectors unless a table (``word, vector``) or a word2vec file is given."""

    k: int = 4
    vectors: DataFrame | None = None
    size: int = 100
    file: str | None = None
    binary: bool = False

    def fit(self, bank: DataFrame) -> Model:
        if self.vectors is None and self.file:
            self.vectors = contig2vec.read_vectors(bank.sparkSession, self.file, self.binary)
        if self.vectors is None:
            self.vectors = contig2vec.train(bank, self.k, self.size)
        return self

    def transform(self, bank: DataFrame) -> DataFrame:
        return contig2vec.embed(bank, self.k, self.vectors, **({"size": self.size} if self.vectors is None else {}))


def _columns(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c != "chunk_id"]
    return wide.select("chunk_id", F.array(*(F.col(f"`{c}`").cast("double") for c in names)).alias("features"))


@dataclass
class CoverageModel(Model):
    """A column for each coverage file: CSV by position, TSV by id; missing values are null until ``fill`` is given."""

    files: list[str]
    prefix: str = "cov_"
    fill: float | None = None

    def transform(self, bank: DataFrame) -> DataFrame:
        wide = coverage.model(bank, list(self.files), self.prefix)
        return _columns(wide if self.fill is None else wide.na.fill(self.fill))


@dataclass
class KmerCoverageModel(Model):
    """The median number of times that a chunk's k-mers occur in the bank."""

    k: int = 31

    def transform(self, bank: DataFrame) -> DataFrame:
        return coverage.from_kmers(bank, self.k).select("chunk_id", F.array("value").alias("features"))


@dataclass
class CodingDensityModel(Model):
    """A column for each gene finder: ``fit`` runs those that are installed over the bank, ``transform`` joins their densities."""

    tools: list[str] = field(default_factory=lambda: sorted(coding.TOOLS))
    genes: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, bank: DataFrame) -> Model:
        found = coding.available(self.tools)
        if not found and not self.genes:
            raise FileNotFoundError(f"none of {self.tools} is installed")
        for tool in found:
            if tool not in self.genes:  # an earlier result is a cache hit
                self.genes[tool] = coding.predict(bank, tool)
        return self

    def transform(self, bank: DataFrame) -> DataFrame:
        lengths = bank.select(F.col("chunk_id").alias("seqid"), F.length("seq").alias("length"))
        wide = coding.across_tools({t: coding.density(g, lengths=lengths) for t, g in self.genes.items()})
        return _columns(bank.select("chunk_id").join(wide.withColumnRenamed("seqid", "chunk_id"), "chunk_id", "left").na.fill(0.0))
