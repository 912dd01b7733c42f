"""A whole analysis: rules in, issues, scores and verdict out. Everything returned is a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import consistency as cons
from plumbline.operators import outliers as out
from plumbline.operators import scoring, uniqueness
from plumbline.operators.rules import (
    Rule,
    check_columns,
    compile_rule,
    empty_issues,
    lookup_issues,
    lookup_scores,
    reference_values,
    row_issues,
    row_scores,
)

GROUP_DIMENSIONS = {"uniqueness", "consistency", "reasonableness", "similarity"}


@dataclass
class Analysis:
    """Rules over one table. Row rules share one scan for issues and one aggregate for scores."""

    df: DataFrame
    id_col: str
    rules: list[Rule]

    def __post_init__(self):
        if not self.rules:
            raise ValueError("no rules given")
        check_columns(self.df, self.id_col, self.rules)
        self._checks, self._idle, self._lookups, self._groups = [], [], [], []
        for rule in self.rules:
            if rule.dimension in GROUP_DIMENSIONS:
                self._groups.append(rule)
                continue
            reference = reference_values(self.df, rule)
            if reference is not None:
                self._lookups.append((rule, reference))
            elif rule.dimension == "referential_integrity" and rule.params.get("reference_values") is None:
                self._idle.append(rule)
            else:
                check = compile_rule(self.df, rule)
                if check is None:
                    self._idle.append(rule)
                else:
                    self._checks.append(check)
        self._runs: dict[int, object] = {}

    def _limits(self, rule: Rule) -> DataFrame:
        if rule.params.get("bounds") is not None:
            return out.pinned(self.df, *rule.params["bounds"])
        return out.fences(self.df, rule.column, float(rule.params.get("iqr_factor", 1.5)), rule.params.get("method", "exact"))

    def _forest(self, rule: Rule):
        """The forest run of a rule, or None when the quartile fences apply instead."""
        if rule.params.get("method") not in ("isolation_forest",):
            return None
        from plumbline.operators.forest import forest_run

        key = id(rule)
        if key not in self._runs:
            self._runs[key] = forest_run(
                self.df, self.id_col, rule.column, rule.params.get("model_columns") or [],
                float(rule.params.get("contamination", 0.05)),
            )
        return self._runs[key]

    def _similar(self, rule: Rule):
        from plumbline.operators.similarity import near_duplicates

        key = id(rule)
        if key not in self._runs:
            self._runs[key] = near_duplicates(self.df, self.id_col, rule.column, **rule.params)
        return self._runs[key]

    def _group_issues(self, rule: Rule) -> DataFrame:
        if rule.dimension == "uniqueness":
            return uniqueness.uniqueness_issues(self.df, self.id_col, rule.column)
        if rule.dimension == "consistency":
            return cons.consistency_issues(self.df, self.id_col, rule.column)
        if rule.dimension == "similarity":
            return self._similar(rule).issues()
        forest = self._forest(rule)
        if forest is not None:
            return forest.issues()
        plain = Rule.of(rule.column, "reasonableness") if rule.params.get("method") == "isolation_forest" else rule
        return out.iqr_issues(self.df, self.id_col, rule.column, self._limits(plain))

    def _group_scores(self, rule: Rule) -> DataFrame:
        if rule.dimension == "uniqueness":
            return uniqueness.uniqueness_scores(self.df, rule.column)
        if rule.dimension == "consistency":
            return cons.consistency_scores(self.df, self.id_col, rule.column)
        if rule.dimension == "similarity":
            return self._similar(rule).scores()
        forest = self._forest(rule)
        if forest is not None:
            return forest.scores()
        plain = Rule.of(rule.column, "reasonableness") if rule.params.get("method") == "isolation_forest" else rule
        return out.iqr_scores(self.df, rule.column, self._limits(plain))

    def issues(self) -> DataFrame:
        """All findings: record_id, column, dimension, reason, value and the extras of group rules."""
        parts = [row_issues(self.df, self.id_col, self._checks)] if self._checks else []
        parts += [lookup_issues(self.df, self.id_col, r, ref) for r, ref in self._lookups]
        parts += [self._group_issues(r) for r in self._groups]
        return scoring.issue_union(parts) if parts else empty_issues(self.df, self.id_col)

    def scores(self) -> DataFrame:
        """(column, dimension, n_total, n_bad, score) of every rule."""
        parts = [row_scores(self.df, self._checks, self._idle)] if self._checks or self._idle else []
        parts += [lookup_scores(self.df, r, ref) for r, ref in self._lookups]
        parts += [self._group_scores(r) for r in self._groups]
        return scoring.issue_union(parts)

    def scorecard(self, weights: DataFrame, issues: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
        """One row: counts, simple and weighted score, usable records, worst critical dimension, verdict."""
        issues = self.issues() if issues is None else issues
        scores = self.scores() if scores is None else scores
        parts = {
            "simple_mean": scoring.simple_mean(scores),
            "weighted_score": scoring.weighted_score(scores, weights),
            "usable": scoring.usable_records(self.df, issues, scores, weights).select(F.struct("usable", "usable_pct")),
            "worst": scoring.verdict(scores, weights).select(F.struct("dimension", "score", "verdict")),
        }
        base = scoring.summary(self.df, issues, scores)
        wide = base.select("*", *[part.scalar().alias(name) for name, part in parts.items()])
        return wide.select(
            "total_records", "records_with_problems", "clean_pct", "simple_mean", "weighted_score",
            "usable.usable", "usable.usable_pct",
            F.col("worst.dimension").alias("worst_critical"), F.col("worst.score").alias("worst_critical_score"),
            "worst.verdict",
        )
