"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on a bounded sample of labelled documents. Every path in them is a rule, a
conjunction of comparisons. A logistic regression with an L1 penalty gives most rules no weight; the
rest become Spark column expressions, so scoring is one narrow pass of built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import keyed_text, made_once, pick, whole_rows

SAMPLE_ROWS = 20_000  # bound of the labelled sample that the driver fits on
N_TREES, DEPTH, MIN_LEAF, N_CUTS = 40, 3, 20, 32
LEAF_SHARE, LEAST_LEAF = 0.1, 2  # a leaf holds this share of the rarer label, within LEAST_LEAF and MIN_LEAF rows
PENALTY, STEPS = 0.004, 400
SEED = 7

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_SYMBOLS = "#*$%&|<>{}[]\\^~=_+@/"
_MARKS = ".,;:?!'\"()-"
FEATURES = (
    "n_words", "word_length", "symbol_share", "mark_share", "bang_share", "capital_share", "digit_share",
    "distinct_words", "distinct_lines", "line_words", "short_line_share", "sentence_ends",
)


def _count(text: Column, signs: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, signs, ""))


def with_statistics(rows: DataFrame) -> DataFrame:
    """Add ``FEATURES`` to ``id, text``; every one is a number for any text, null counting as empty."""
    text = F.coalesce("text", F.lit(""))
    cut = rows.select(
        "id", text.alias("text"), F.array_remove(F.split(text, r"\s+"), "").alias("words"), F.array_remove(F.split(text, "\n"), "").alias("lines")
    )
    sized = cut.select(
        "id", "text", "words", "lines",
        F.char_length("text").alias("n_chars"), F.size("words").alias("n"), F.size("lines").alias("n_lines"),
    )
    chars, words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_chars", "n", "n_lines"))
    found = sized.select(
        "id",
        F.col("n").cast("double").alias("n_words"),
        ((F.col("n_chars") - _count(F.col("text"), " \n\t\r")) / words).alias("word_length"),
        (_count(F.col("text"), _SYMBOLS) / chars).alias("symbol_share"),
        (_count(F.col("text"), _MARKS) / chars).alias("mark_share"),
        (_count(F.col("text"), "!") / words).alias("bang_share"),
        (_count(F.col("text"), _CAPITALS) / chars).alias("capital_share"),
        (_count(F.col("text"), "0123456789") / chars).alias("digit_share"),
        (F.size(F.array_distinct("words")) / F.sqrt(words)).alias("distinct_words"),
        (F.size(F.array_distinct("lines")) / lines).alias("distinct_lines"),
        (F.col("n") / lines).alias("line_words"),
        (F.size(F.filter("lines", lambda x: F.char_length(x) < 20)) / lines).alias("short_line_share"),
        (F.regexp_count("text", F.lit(r"[.?!](?=\s|$)")) / words).alias("sentence_ends"),
    )
    # Never null: the code made for the rules stays small.
    return found.select("id", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES))


@dataclass(frozen=True)
class Rule:
    """Holds where every ``(feature, at_most, cut)``: value <= cut, or value > cut."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for feature, at_most, cut in self.parts:
            out &= (values[:, feature] <= cut) == at_most
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for feature, at_most, cut in self.parts:
            value = F.col(FEATURES[feature])
            out = out & ((value <= F.lit(cut)) if at_most else (value > F.lit(cut)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'<=' if at_most else '>'} {cut:.6g}" for f, at_most, cut in self.parts)


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * rule.holds(values)
        return 1 / (1 + np.exp(-total))

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(values: np.ndarray, target: np.ndarray, rows: np.ndarray, features: np.ndarray, cuts: list[np.ndarray], depth: int, min_leaf: int) -> list[tuple]:
    """Paths to all nodes of a least-squares tree, with the mean of the target in each leaf."""
    found: list[tuple] = []
    open_nodes = [((), rows)]
    while open_nodes:
        path, inside = open_nodes.pop()
        best = None
        if len(path) < depth and len(inside) >= 2 * min_leaf:
            sums, total = target[inside], target[inside].sum()
            for f in features:
                if not len(cuts[f]):
                    continue
                bins = np.searchsorted(cuts[f], values[inside, f], "left")
                n_left = np.cumsum(np.bincount(bins, minlength=len(cuts[f]) + 1))[:-1]
                s_left = np.cumsum(np.bincount(bins, weights=sums, minlength=len(cuts[f]) + 1))[:-1]
                n_right = len(inside) - n_left
                fits = (n_left >= min_leaf) & (n_right >= min_leaf)
                if not fits.any():
                    continue
                gain = np.where(fits, s_left**2 / np.maximum(n_left, 1) + (total - s_left) ** 2 / np.maximum(n_right, 1), -np.inf)
                at = int(np.argmax(gain))
                if best is None or gain[at] > best[0] + 1e-12:
                    best = (gain[at], int(f), float(cuts[f][at]))
            if best is not None and best[0] <= total**2 / len(inside) + 1e-9:
                best = None
        found.append((path, inside, best is None))
        if best is not None:
            low = values[inside, best[1]] <= best[2]
            open_nodes.append(((*path, (best[1], True, best[2])), inside[low]))
            open_nodes.append(((*path, (best[1], False, best[2])), inside[~low]))
    return found


def simplified(path: tuple) -> tuple:
    """One bound at most per feature and side, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, at_most, cut in path:
        old = bounds.get((f, at_most))
        bounds[f, at_most] = cut if old is None else min(old, cut) if at_most else max(old, cut)
    return tuple((f, at_most, cut) for (f, at_most), cut in sorted(bounds.items()))


def grow_rules(values: np.ndarray, labels: np.ndarray, n_trees: int = N_TREES, depth: int = DEPTH, min_leaf: int = MIN_LEAF, seed: int = SEED) -> list[Rule]:
    """Rules of trees that are boosted on half samples with half of the features each."""
    random = np.random.default_rng(seed)
    cuts = []
    for f in range(values.shape[1]):
        edges = np.unique(np.quantile(values[:, f], np.linspace(0, 1, N_CUTS + 2)[1:-1], method="lower"))
        cuts.append(edges[edges < values[:, f].max()])
    rate = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    margin = np.full(len(labels), np.log(rate / (1 - rate)))
    rules: dict[Rule, None] = {}
    for _ in range(n_trees):
        residual = labels - 1 / (1 + np.exp(-margin))
        rows = np.sort(random.choice(len(labels), max(1, len(labels) // 2), replace=False))
        features = np.sort(random.choice(values.shape[1], max(1, values.shape[1] // 2), replace=False))
        for path, inside, leaf in tree_paths(values, residual, rows, features, cuts, depth, min_leaf):
            if path:
                rule = Rule(simplified(path))
                rules[rule] = None
                if leaf:
                    margin += np.clip(residual[inside].mean() * 2, -1, 1) * rule.holds(values)
    return list(rules)


def fit_lasso(held: np.ndarray, labels: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression (accelerated proximal gradient)."""
    n, m = held.shape
    weights = moved = np.zeros(m)
    intercept = moved0 = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    rate, t = 4.0 / max(np.linalg.norm(held, 2) ** 2 / n + 1, 1e-9), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(held @ moved + moved0, -30, 30))) - labels
        step = moved - rate * (held.T @ error) / n
        new, new0 = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), moved0 - rate * error.mean()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved, moved0 = new + (t - 1) / following * (new - weights), new0 + (t - 1) / following * (new0 - intercept)
        weights, intercept, t = new, new0, following
    return float(intercept), weights


def smallest_leaf(labels: np.ndarray) -> int:
    """Rows that a leaf needs: few where one label is rare, so that a small sample has rules too."""
    rarer = min(labels.sum(), len(labels) - labels.sum())
    return int(min(MIN_LEAF, max(LEAST_LEAF, LEAF_SHARE * rarer)))


def fit_rules(values: np.ndarray, labels: np.ndarray) -> RuleModel:
    """A model of 0/1 labels. Without rows, or with one label only, it has no rules."""
    n, good = len(labels), float(labels.sum()) if len(labels) else 0.0
    plain = RuleModel(float(np.log((good + 1) / (n - good + 1))), (), ())
    if not 0 < good < n:
        return plain
    rules = grow_rules(values, labels, min_leaf=smallest_leaf(labels))
    if not rules:
        return plain
    held = np.column_stack([r.holds(values) for r in rules]).astype(float)
    intercept, weights = fit_lasso(held, labels)
    kept = np.flatnonzero(weights)
    return RuleModel(intercept, tuple(rules[i] for i in kept), tuple(float(weights[i]) for i in kept))


def in_training(id_column: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text is no multiple of 5. Never for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def train_quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled documents, those whose ids have the smallest hashes.

    Labels of ids outside ``in_training``, null ids and null labels are never read into the sample; an id with both labels
    counts as 0. Only the sample, bounded by the parameter, is broadcast and collected.
    """
    known = pick(labels, of=label_id_col, label=label_col)
    known = known.where(F.col("of").isNotNull() & F.col("label").isNotNull() & in_training(F.col("of")))
    chosen = known.groupBy("of").agg(F.min("label").alias("label")).orderBy(F.xxhash64("of"), "of").limit(sample_rows)
    rows = keyed_text(docs, id_col, text_col)
    sample = rows.join(F.broadcast(chosen), F.col("id") == F.col("of"), "left_semi")
    found = with_statistics(sample).join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "label", *FEATURES).toPandas()
    found = found.sort_values(["id", *FEATURES], kind="stable").head(sample_rows)
    return fit_rules(found[list(FEATURES)].to_numpy(float), (found["label"].to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: one row per document, in one narrow pass.

    Null texts are scored as empty; repeated rows get the same score; an empty table gives no rows; texts of any
    length are read whole; other columns are not read.
    """
    rows = keyed_text(docs, id_col, text_col)
    return made_once(with_statistics(rows).select(F.col("id").alias("doc_id"), model.column().alias("score")), "score")


def keep_good(docs: DataFrame, model: RuleModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts score at least ``threshold``, as they are; no join and no shuffle.

    Null texts are scored as empty; a score at the threshold stays; repeated rows stay or go together; an empty table
    gives no rows.
    """
    rows = whole_rows(docs, text_col).withColumnRenamed("row", "id")
    scored = made_once(with_statistics(rows).select("id", model.column().alias("score")), "score")
    return scored.where(F.col("score") >= threshold).select("id.*")
