"""Decision gates over one-row metric frames: eligibility, regressions, verdicts, constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(df: DataFrame) -> DataFrame:
    """Candidates with a gain on the anchor, no loss on the hard set and both health flags."""
    return df.where((F.col("delta_anchor") > 0) & (F.col("delta_hard") >= 0) & F.col("health_a") & F.col("health_b"))


def no_regression(candidate: str = "c", base: str = "b", less=("empty_pct", "copy_pct", "short_pct", "repeat_pct"), more=("unique_pct",)) -> Column:
    """Is each share no worse than the base's, after rounding the difference to 4 places."""
    out = F.lit(True)
    for m in less:
        out = out & (F.round(F.col(f"{candidate}_{m}") - F.col(f"{base}_{m}"), 4) <= 0)
    for m in more:
        out = out & (F.round(F.col(f"{candidate}_{m}") - F.col(f"{base}_{m}"), 4) >= 0)
    return out


#: Thresholds of the gates; each verdict's conditions hold together.
GATES: dict[str, list[tuple[str, str]]] = {
    "retrieval": [("accept", "delta >= 0.25 AND hard >= 0 AND bucket > 0 AND latency <= 1.8 AND health"), ("review", "delta >= 0 AND hard >= 0")],
    "term_patch": [("accept", "delta >= 0.10 AND bucket >= 0.20"), ("review", "delta >= -0.05 AND (bucket >= 0.20 OR hard >= 0.20)")],
    "policy": [("accept", "score > random_p95 AND delta >= 0.05"), ("review", "delta >= -0.05")],
    "row_gate": [("accept", "score >= random_p95 + 0.03 AND delta >= 0.05"), ("review", "score > random_p95 AND delta > 0")],
    "diversity": [("accept", "delta >= -1 AND (oracle_gain >= 0.5 OR heuristic_gain >= 0.15) AND disagreement >= 15"), ("review", "delta >= -1")],
    "promote": [("accept", "delta >= 0.2 AND health"), ("review", "delta >= 0")],
}


def verdict(gate: str) -> Column:
    """accept, review or reject of a metrics row under the named gate."""
    out = F.lit("reject")
    for name, condition in reversed(GATES[gate]):
        out = F.when(F.expr(condition), name).otherwise(out)
    return out


def violations(metrics: DataFrame, constraints: Sequence[tuple[str, str, float, str]], key: Sequence[str] = ()) -> DataFrame:
    """Per metrics row its violated constraints, as issues and warnings; (metric, operator, limit, severity) each."""
    checks = []
    for metric, op, limit, severity in constraints:
        c = F.col(metric)
        holds = {"<=": c <= limit, ">=": c >= limit, "<": c < limit, ">": c > limit}[op]
        checks.append(F.struct(F.lit(severity).alias("severity"), F.when(~F.coalesce(holds, F.lit(False)), f"{metric} {op} {limit:g}").alias("name")))
    bad = F.filter(F.array(*checks), lambda x: x["name"].isNotNull())
    of = lambda s: F.array_join(F.transform(F.filter(bad, lambda x: x["severity"] == s), lambda x: x["name"]), "; ")
    return metrics.select(*key, of("issue").alias("issues"), of("warning").alias("warnings"), (F.size(F.filter(bad, lambda x: x["severity"] == "issue")) == 0).alias("ok"))


#: Acceptance limits, in percent.
ACCEPTANCE = {
    "smoke": {"extra_id_pct": 1, "short_pct": 55, "empty_pct": 5, "copy_pct": 15, "src_trunc_pct": 10, "tgt_trunc_pct": 8},
    "baseline": {"extra_id_pct": 0.5, "short_pct": 45, "empty_pct": 2, "copy_pct": 10, "src_trunc_pct": 8, "tgt_trunc_pct": 6},
}


def acceptance(metrics: DataFrame, profile: str, key: Sequence[str] = ()) -> DataFrame:
    return violations(metrics, [(m, "<=", float(x), "issue") for m, x in ACCEPTANCE[profile].items()], key)


def differing_settings(a: dict, b: dict, keys: Sequence[str]) -> list[str]:
    """Dotted keys whose values differ between two configurations."""

    def at(config: dict, key: str):
        for part in key.split("."):
            config = config.get(part, {}) if isinstance(config, dict) else {}
        return config

    return [k for k in keys if at(a, k) != at(b, k)]


def consistent_settings(runs: DataFrame, config: str, keys: Sequence[str]) -> DataFrame:
    """(setting, n_values, consistent) over the JSON configurations of runs; a missing setting is a value of its own."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.get_json_object(config, f"$.{k}").alias("v")) for k in keys]))
    found = runs.select(values.alias("x")).groupBy("x.setting").agg((F.count_distinct("x.v") + F.max(F.col("x.v").isNull().cast("int"))).alias("n_values"))
    return found.withColumn("consistent", F.col("n_values") <= 1)


def parameter_grid(df: DataFrame, lists: dict[str, Sequence]) -> DataFrame:
    """Each row with every combination of the values; the lists are short parameters."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def mix_plan(available: Column, train_rows: Column, ratios: dict[str, float]) -> Column:
    """An array of (name, wanted, status) of the mixes by ratio."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("mix"),
                F.bround(train_rows * r).cast("long").alias("wanted"),
                F.when(available >= F.bround(train_rows * r), "ready").otherwise("insufficient").alias("status"),
            )
            for name, r in ratios.items()
        ]
    )
