"""Whole flows built from the operators: table preparation, match reports, classifier reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import moment, round_half_even, year_of
from millrace.functions.vectors import argmax, softmax
from millrace.operators import clean, encode, evaluate, fold, inspect, learn, ordered, pixels, report, sample
from millrace.session import stage
from millrace.sources import folders


@dataclass
class TableSpec:
    """What a dirty two-part table holds; every entry is the caller's."""

    key: str
    order: Sequence[str]
    drop: Sequence[str] = ()
    numeric_text: Sequence[str] = ()
    categories: Sequence[str] = ()
    token_list: str | None = None
    codes: Mapping[str, Mapping] = field(default_factory=dict)
    durations: Sequence[str] = ()
    bounds: Mapping[str, tuple] = field(default_factory=dict)
    fences: Mapping[str, float] = field(default_factory=dict)
    fill: Sequence[str] = ()
    target: str | None = None


def prepare_tables(train: DataFrame, test: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Clean, encode and scale a train and a test table the same way.

    Text to numbers, own medians for gaps, indicator columns, codes and durations, range
    and quartile outliers, per-key fill, complete rows, standard scale. Categories, tokens,
    fences and the scale come from train; the target is coded but neither filled nor scaled.
    """
    parts = {"train": train, "test": test}
    held = {spec.key, *spec.order, *([spec.target] if spec.target else [])}
    for name, df in parts.items():
        df = df.drop(*spec.drop)
        parts[name] = clean.nan_to_null(df.withColumns({c: clean.to_numeric(c) for c in spec.numeric_text}))
    levels = encode.categories(parts["train"], spec.categories) if spec.categories else {}
    split = encode.split_list(spec.token_list) if spec.token_list else None
    tokens = encode.fit_tokens(parts["train"].select(split.alias("t")), "t") if spec.token_list else []
    for name, df in parts.items():
        numbers = [c for c in inspect.columns_of_type(df, "number") if c not in held]
        if numbers:
            df = clean.fill_with(df, clean.fit_medians(df, numbers), numbers)
        df = encode.one_hot(df, levels) if levels else df
        if spec.token_list:
            df = df.withColumn(spec.token_list, clean.missing_list_to_empty(split))
            df = encode.multi_hot(df, spec.token_list, tokens).drop(spec.token_list)
        parts[name] = df
    if spec.target and spec.target not in parts["test"].columns:
        parts["test"] = parts["test"].withColumn(spec.target, F.lit(None).cast(parts["train"].schema[spec.target].dataType))
    parts["train"], parts["test"] = (inspect.sort_columns(df) for df in inspect.align(parts["train"], parts["test"]))
    for name, df in parts.items():
        codes = {c: clean.recode(c, m).cast("double") for c, m in spec.codes.items()}
        df = df.withColumns(codes | {c: clean.months_of(c).cast("double") for c in spec.durations})
        parts[name] = clean.drop_out_of_range(df, spec.bounds)
    if spec.fences:
        fences = clean.fit_fences(parts["train"], spec.fences)
        parts = {name: clean.apply_fences(df, fences, list(spec.fences)) for name, df in parts.items()}
    for name, df in parts.items():
        df = clean.fill_by_key(df, spec.key, spec.order, spec.fill) if spec.fill else df
        features = [c for c in df.columns if c != spec.target]
        parts[name] = df.na.drop("any", subset=df.columns if name == "train" else features)
    numbers = [c for c in inspect.columns_of_type(parts["train"], "double", "float", "integer", "long") if c not in held]
    scaled = encode.varied_columns(parts["train"], numbers)
    stats = encode.fit_standard(parts["train"], scaled)
    done = [clean.flags_to_int(encode.standardise(df, stats, scaled)) for df in parts.values()]
    return done[0], done[1]


def match_reports(matches: DataFrame, pool: str, order: Sequence[str], date: str, min_matches: int = 300, top_n: int = 20) -> dict[str, DataFrame]:
    """Rating history, the top teams, yearly leaders, and clean-sheet and win rates of the top teams.

    Columns as in ``rating_history``; the history is folded once and written for the reports.
    """
    history = stage(fold.rating_history(matches, pool, order), "history")
    final = fold.final_ratings(history, pool, order, min_matches)
    best = report.top(final, "elo", top_n, [pool, "team"])
    peak = history.withColumn("top", F.greatest("home_elo", "away_elo"))
    leader = F.when(F.col("home_elo") > F.col("away_elo"), F.col("home")).otherwise(F.col("away")).alias("team")
    earlier: list[Column] = [moment(date), *[F.col(c) for c in order if c != date]]
    roles = report.only_top(report.role_rows(matches, keep=[pool]), best, [pool, "team"])
    return {
        "history": history,
        "top": best.withColumn("elo", round_half_even("elo")),
        "yearly": ordered.best_per_period(peak, year_of(date), "top", earlier, [F.col(pool), leader, F.col("top")]),
        "clean_sheets": report.clean_sheets(roles, [pool, "team"]),
        "win_rates": report.win_rates(roles, [pool, "team"]),
    }


def classifier_reports(scored: DataFrame, label: str, logits: str, bins: int | None = None) -> dict[str, DataFrame]:
    """Confusion grid, class report, curves per class, macro and micro areas, combined loss."""
    labels = scored.select(F.col(label).alias("y"), argmax(logits).alias("pred"))
    cells = stage(evaluate.observed(labels, "y", "pred"), "confusion")
    long = evaluate.one_vs_rest(scored.select(F.col(label).alias("y"), softmax(logits).alias("probs")), "y", "probs")
    counts = evaluate.score_counts(long, "y", "score", ["class"], bins)
    per_class = evaluate.areas(counts, ["class"])
    macro = per_class.agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap")).select(F.lit("macro").alias("kind"), "auc", "ap")
    return {
        "confusion": evaluate.grid(cells),
        "report": evaluate.report(cells),
        "roc": evaluate.roc_curve(counts, ["class"]),
        "pr": evaluate.pr_curve(counts, ["class"]),
        "areas": macro.unionByName(evaluate.areas(evaluate.pooled(counts)).select(F.lit("micro").alias("kind"), "auc", "ap")),
        "loss": evaluate.combined_loss(scored, logits, label),
    }


def prepared_folder(
    spark: SparkSession,
    root: str,
    chains: Mapping[str, Sequence[pixels.Step]],
    shares: Mapping[str, float],
    keep: Column | None = None,
    seed: int = 0,
) -> DataFrame:
    """Labelled images below ``root``, split by hash, each split through its own chain.

    ``keep`` filters on height and width before any pixel is touched.
    """
    found = folders.scan_labeled_folder(spark, root)
    found = found if keep is None else found.filter(keep)
    split = sample.hash_split(found, "path", dict(shares), seed)
    return pixels.run(split, "data", "path", ["height", "width", "channels"], chains, split="split", seed=seed)


def folder_reports(images: DataFrame, layers: learn.Layers, activation: str = "relu", split: str = "test") -> dict[str, DataFrame]:
    """Score the prepared images of one split with a network's weights and report on them."""
    rows = images.filter(F.col("split") == split).select("path", "label", "data")
    scored = stage(learn.score(rows, "data", layers, activation), "scored")
    return classifier_reports(scored, "label", "logits")
