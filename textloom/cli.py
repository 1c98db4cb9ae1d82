"""Command line: fit, merge, refit, search, list, info, install, uninstall."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.operators import vocabulary as vb
from textloom.operators.expansion import neighbours
from textloom.operators.index import grep
from textloom.operators.profile import merge_profiles, refit_config, refit_profile
from textloom.operators.tokens import tokenize
from textloom.pipeline import fit_batches, load_config
from textloom.scratch import Scratch
from textloom.sources import profiles as store
from textloom.sources.records import FORMATS, read_records


def _spark() -> SparkSession:
    return SparkSession.builder.appName("textloom").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _docs(spark, args):
    df = read_records(spark, args.format, args.corpus, args.text_key)
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.monotonically_increasing_id())


def _save(p, target: str) -> None:
    if not target.endswith(".zip"):
        raise SystemExit("the output must end in .zip")
    scratch = Scratch(p.model.weights.sparkSession, "profile")  # tables in the shared folder; only the zip is local
    store.save_profile(f"{scratch.path}/p", p)
    store.zip_profile(f"{scratch.path}/p", target)
    scratch.drop("p")


def cmd_fit(args) -> None:
    spark = _spark()
    cfg = load_config(args.config)
    parts = cfg.batch_size > 0

    def target_of(k: int) -> str:
        return args.output.removesuffix(".zip") + f"-{k:05d}.zip" if parts else args.output

    # a batch whose profile is there is not fitted again
    for k, p in fit_batches(_docs(spark, args), cfg, args.text_key, skip=lambda k: args.resume and os.path.exists(target_of(k))):
        target = target_of(k)
        _save(p, target)
        print(target)


def cmd_merge(args) -> None:
    spark = _spark()
    paths = store.expand_specs(args.profiles)
    if len(paths) < 2:
        raise SystemExit("merge needs two profiles at least")
    _save(merge_profiles([store.load_profile(spark, p) for p in paths], args.doc_freq_threshold, args.synonyms_k), args.output)


def kappa_of(kappa: float | None, weight: float | None, sample: int) -> float:
    """Documents of prior: given, or such that the base weighs ``weight`` of the whole."""
    if kappa is not None and weight is not None:
        raise SystemExit("give --kappa or --base-weight, not both")
    if weight is not None:
        if not 0 < weight < 1:
            raise SystemExit("--base-weight must be between 0 and 1")
        return sample * weight / (1 - weight)
    return kappa or 0


def _length(text: str) -> str | float:
    if text in ("blend", "sample"):
        return text
    try:
        if float(text) > 0:
            return float(text)
    except ValueError:
        pass
    raise argparse.ArgumentTypeError("blend, sample or a positive number")


def cmd_refit(args) -> None:
    kappa_of(args.kappa, args.base_weight, 1)
    if args.extend_lemmas and args.no_lemmas:
        raise SystemExit("--extend-lemmas contradicts --no-lemmas")
    if not args.output.endswith(".zip"):
        raise SystemExit("the output must end in .zip")
    spark = _spark()
    base = store.load_profile(spark, store.resolve(args.base))
    docs = _docs(spark, args).withColumnRenamed(args.text_key, "text")
    n = docs.count()
    p = refit_profile(base, docs, kappa_of(args.kappa, args.base_weight, n), not args.no_lemmas, avgdoclen=args.avgdoclen, extend=args.extend_lemmas)
    _save(p, args.output)


def cmd_search(args) -> None:
    spark = _spark()
    p = store.load_profile(spark, store.resolve(args.profile))
    docs = _docs(spark, args)
    one = spark.createDataFrame([(args.query,)], "text string")
    base = tokenize(one, p.cfg, "text").first()["tokens"]
    words = list(base)
    if p.synonyms is not None and args.synonyms >= 0:
        for s in neighbours(p.synonyms, base, args.synonyms):
            words += tokenize(spark.createDataFrame([(s,)], "text string"), p.cfg, "text").first()["tokens"]
    hits = grep(tokenize(docs, p.cfg, args.text_key, "__tokens"), words, args.threshold, "__tokens", args.mode)
    for row in hits.orderBy("doc_id").select(F.to_json(F.struct(*docs.columns)).alias("j")).toLocalIterator():
        print(row["j"])


def cmd_list(args) -> None:
    for n in store.list_nicknames():
        print(n)


def cmd_info(args) -> None:
    m = store.read_manifest(store.resolve(args.profile))
    print(json.dumps({k: m[k] for k in ("format_version", "weighting", "applied", "trainsize", "numtokens", "lineage", "files")}, indent=1, ensure_ascii=False))


def cmd_install(args) -> None:
    print(store.install(args.path, args.nickname))


def cmd_uninstall(args) -> None:
    """Only say which file to remove."""
    path = store.profile_path(args.nickname)
    if not path.exists():
        raise SystemExit(f"no profile {args.nickname!r}")
    print(path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def corpus(p):
        p.add_argument("corpus")
        p.add_argument("--format", choices=FORMATS, default="jsonl")
        p.add_argument("--text-key", default="text")

    p = sub.add_parser("fit")
    corpus(p)
    p.add_argument("--config", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--resume", action="store_true")
    p.set_defaults(run=cmd_fit)
    p = sub.add_parser("merge")
    p.add_argument("profiles", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--doc-freq-threshold", type=float, default=0.5)
    p.add_argument("--synonyms-k", type=int, default=0)
    p.set_defaults(run=cmd_merge)
    p = sub.add_parser("refit")
    p.add_argument("base")
    corpus(p)
    p.add_argument("--output", required=True)
    p.add_argument("--kappa", type=float)
    p.add_argument("--base-weight", type=float)
    p.add_argument("--avgdoclen", type=_length, default="blend")
    p.add_argument("--no-lemmas", action="store_true")
    p.add_argument("--extend-lemmas", action="store_true")
    p.set_defaults(run=cmd_refit)
    p = sub.add_parser("search")
    p.add_argument("profile")
    p.add_argument("query")
    corpus(p)
    p.add_argument("--threshold", type=int, default=1)
    p.add_argument("--mode", choices=("count", "set"), default="count")
    p.add_argument("--synonyms", type=int, default=-1, help="neighbours of each query token to add; 0 is all, -1 none")
    p.set_defaults(run=cmd_search)
    for name, run, arg in (("list", cmd_list, None), ("info", cmd_info, "profile"), ("install", cmd_install, "path"), ("uninstall", cmd_uninstall, "nickname")):
        p = sub.add_parser(name)
        if arg:
            p.add_argument(arg)
        if name == "install":
            p.add_argument("--nickname")
        p.set_defaults(run=run)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    args.run(args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
