"""Command line: ``model`` characterises sequences, ``describe`` shows a store, ``extract`` clusters it."""

from __future__ import annotations

import argparse

from . import __citation__, __version__
from .operators.bank import BankSpec, must_link_stats
from .plans.pipeline import DEFAULT_MODELS, Extraction, characterize, extract
from .session import session
from .sources import fasta
from .operators.reduce import KERNELS
from .operators.vbgmm import DEFAULT_RESTARTS
from .sources.tables import Store, rewrite, write_clustering


def parser() -> argparse.ArgumentParser:
    # Option names and defaults are fixed values: they are the interface.
    p = argparse.ArgumentParser(prog="helixbin", description=__doc__)
    p.add_argument("-v", "--version", action="version", version=__version__)
    p.add_argument("--citation", action="version", version=__citation__)
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("model")
    m.add_argument("--input", required=True)
    m.add_argument("--format", default="fasta", choices=[*fasta.FIRST, "auto"])
    m.add_argument("--min_length", type=int, default=1000)
    m.add_argument("--chunk_size", type=int, default=10000)
    m.add_argument("--overlap", default="auto")
    m.add_argument("--outfile", default=None, help="the store's folder; the input's name with the bank's parameters if left out")
    m.add_argument("--coverage", nargs="*", default=[], help="CSV files by position or TSV files by id")
    m.add_argument("--models", nargs="*", default=sorted(DEFAULT_MODELS), choices=sorted(DEFAULT_MODELS))
    d = sub.add_parser("describe")
    d.add_argument("--input", required=True)
    d.add_argument("--db_size", action="store_true")
    d.add_argument("--list_models", action="store_true")
    d.add_argument("--repack", action="store_true")
    e = sub.add_parser("extract")
    e.add_argument("--input", required=True)
    e.add_argument("--outfile", required=True)
    e.add_argument("--models", nargs="*", default=["kmers4", "kmers110011", "contig2vec4", "ind15"])
    e.add_argument("--max_iter", type=int, default=25)
    e.add_argument("--max_cluster", type=int, default=600)
    e.add_argument("--kpca_inertia", type=float, default=0.85)
    e.add_argument("--kpca_t", type=float, default=0.33)
    e.add_argument("--kernel", default="cosine", choices=list(KERNELS))
    e.add_argument("--init", default="kmeans", choices=["kmeans", "mustlink"])
    e.add_argument("--ppmode", default="reassigntiny", choices=["nopostprocessing", "reassigntiny"])
    e.add_argument("--min_cluster_size", type=int, default=50)
    e.add_argument("--seed", type=int, default=666)
    e.add_argument("--label", default="helixbin", help="names the reports' folder")
    e.add_argument("--reports", default=None, help="a folder for tables of each iteration")
    e.add_argument("--state", default=None, help="a folder where iterations are committed, so that a run that ended early goes on")
    e.add_argument("--pca_inertia", type=float, default=0.99)
    e.add_argument("--max_components", type=int, default=250)
    e.add_argument("--restarts", type=int, default=DEFAULT_RESTARTS)
    e.add_argument("--vb_iter", type=int, default=600)
    e.add_argument("--epsilon", type=float, default=1e-2)
    e.add_argument("--bound", default="compat", choices=["compat", "elbo"])
    for s in (m, d, e):
        s.add_argument("--master", default=None)
        s.add_argument("--verbosity", type=int, default=3, choices=[0, 1, 2, 3, 4])
        s.add_argument("--n_jobs", type=int, default=0, help="threads of a local master")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(a.master or (f"local[{a.n_jobs}]" if a.n_jobs else None))
    spark.sparkContext.setLogLevel(("OFF", "FATAL", "ERROR", "WARN", "INFO")[a.verbosity])
    if a.command == "model":
        spec = BankSpec(a.min_length, a.chunk_size, a.overlap if a.overlap == "auto" else int(a.overlap))
        characterize(spark, fasta.read(spark, a.input, None if a.format == "auto" else a.format), a.outfile or spec.file_stem(a.input.rsplit(".", 1)[0]), spec, {m: DEFAULT_MODELS[m] for m in a.models}, a.coverage)
    elif a.command == "describe":
        store = Store(spark, a.input)
        if a.db_size or not a.list_models:
            print(must_link_stats(store.bank()[0]).first().asDict())
        if a.list_models or not a.db_size:
            print("\n".join(store.models()))
        if a.repack:
            rewrite(store)
    else:
        store = Store(spark, a.input)
        p = Extraction(max_iter=a.max_iter, max_cluster=a.max_cluster, min_rows=a.min_cluster_size, kpca={"inertia": a.kpca_inertia, "t": a.kpca_t, "kernel": a.kernel}, init=a.init, mode=a.ppmode, seed=a.seed, pca_inertia=a.pca_inertia, max_components=a.max_components, restarts=a.restarts, vb_iter=a.vb_iter, epsilon=a.epsilon, bound=a.bound)
        reports = f"{a.reports.rstrip('/')}/{a.label}" if a.reports else None
        write_clustering(extract(spark, store.bank()[0], store.load_models(a.models), p, reports, a.state), a.outfile)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
