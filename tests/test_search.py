import itertools
import random

import pytest

from tallyframe.operators import curves, metrics, search, votes

MODELS, PROMPTS = ["m2", "m0", "m1"], ["q", "p"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows = [
        (f"{i}", p, m, rng.choice([True, False, False, None]))
        for i in range(80)
        for p in PROMPTS
        for m in MODELS
        for _ in range(rng.choice([0, 1, 1, 1, 2]))  # absent and repeated voters
    ]
    labels = [(f"{i}", rng.choice([True, False, None])) for i in range(5, 90)]
    return (
        spark.createDataFrame(rows, "id string, prompt string, model string, vote boolean").cache(),
        spark.createDataFrame(labels, "id string, matches_original boolean").cache(),
    )


def subsets(members):
    members = sorted(members)
    return [s for n in range(1, len(members) + 1) for s in itertools.combinations(members, n)]


def test_every_subset_equals_the_plain_operators(spark, tables):
    verdicts, labels = tables
    found = search.subset_votes(verdicts, labels, MODELS, PROMPTS).cache()
    profile = search.subset_profile(found)
    named = search.named(search.subset_vote_metrics(profile), MODELS, PROMPTS)
    got = {(r.ensemble, r.prompt_group, r.column): r for r in named.collect()}
    best = {
        (r.ensemble, r.prompt_group): r
        for r in search.named(search.subset_best_thresholds(profile), MODELS, PROMPTS).collect()
    }
    areas = {
        (r.ensemble, r.prompt_group): r.auc_pr
        for r in search.named(search.subset_auc_pr(verdicts, labels, MODELS, PROMPTS), MODELS, PROMPTS).collect()
    }
    pairs = [(m, p) for m in subsets(MODELS) for p in subsets(PROMPTS)]
    assert len(got) == 2 * len(pairs) and len(best) == len(areas) == len(pairs) == 21
    for models, prompts in pairs:
        part = verdicts.where(verdicts.model.isin(*models) & verdicts.prompt.isin(*prompts))
        merged = votes.merge_prompts(votes.prompt_votes(part))
        plain = metrics.vote_metrics(merged, labels, ["majority_vote", "unanimous_vote"])
        name = (",".join(models), ",".join(prompts))
        for row in plain.collect():
            mine = got[(*name, row.column)]
            assert [mine[c] for c in metrics.COUNTS] == [row[c] for c in metrics.COUNTS], name
    # the heavier curves for a few of the pairs
    for models, prompts in pairs[::6]:
        part = verdicts.where(verdicts.model.isin(*models) & verdicts.prompt.isin(*prompts))
        scores = votes.merge_prompts(votes.prompt_votes(part)).selectExpr(
            "'c' AS curve", "id", "percentage_vote AS score"
        )
        name = (",".join(models), ",".join(prompts))
        row = curves.best_threshold(curves.threshold_sweep(scores, labels)).first()
        assert (best[name].t_idx, best[name].f1_score) == (row.t_idx, row.f1_score)
        area = curves.auc_pr(curves.curve_rows(scores, labels)).first().auc_pr
        assert areas[name] == pytest.approx(area, abs=1e-12)


def test_best_subsets_prefers_low_masks(spark):
    rows = [("majority_vote", 2, 1, 0.5, 0.1), ("majority_vote", 1, 3, 0.5, 0.2)]
    df = spark.createDataFrame(
        rows, "column string, model_mask int, prompt_mask int, f1_score double, recall double"
    )
    got = {r.metric: (r.model_mask, r.prompt_mask, r.value)
           for r in search.best_subsets(df, ["f1_score", "recall"]).collect()}
    assert got == {"f1_score": (1, 3, 0.5), "recall": (1, 3, 0.2)}


def test_scaling_over_a_stored_table(spark):
    rows = [("a,b", ",".join("wxyz"[:k]), k / 10) for k in (1, 2, 3, 4)] + [("a", "w,x,y,z", 0.1)]
    df = spark.createDataFrame(rows, "ensemble string, prompt_group string, auc_pr_df double")
    got = {
        (r.varied, r.k): (r.n, r.mean_auc_pr)
        for r in search.scaling_curves(df, 2, 4, area="auc_pr_df").collect()
    }
    assert got == {
        ("models", 1): (1, 0.1), ("models", 2): (1, 0.4), ("prompts", 1): (1, 0.1),
        ("prompts", 2): (1, 0.2), ("prompts", 3): (1, 0.3), ("prompts", 4): (1, 0.4),
    }
    assert search.by_subset_size(df, models=1).count() == 1
    assert search.by_subset_size(df, models=2, prompts=3).count() == 1


def test_sums_before_scores_of_many_buckets(spark):
    rng = random.Random(4)
    rows = [(m, 1, rng.choice([0.0, 1.0, round(rng.random(), rng.choice([1, 3, 12]))]), k, rng.randint(1, 9), rng.randint(0, 3))
            for m in (1, 2) for k in range(300)]
    df = spark.createDataFrame(rows, "model_mask int, prompt_mask int, score double, piece int, n bigint, n_wrong bigint")
    got = {(r.model_mask, r.score): (r.before, r.wrong_before, r.total) for r in search._before_scores(df).collect()}
    assert len(got) == len({r[:3] for r in rows})
    for (mask, score), found in got.items():
        lower = [r for r in rows if r[0] == mask and r[2] < score]
        total = sum(r[5] for r in rows if r[0] == mask)
        assert found == (sum(r[4] for r in lower), sum(r[5] for r in lower), total)


def test_no_window_holds_a_whole_subset(spark, tables):
    plan = search.subset_auc_pr(*tables, MODELS, PROMPTS)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window")]
    assert windows and all("score" in line or "bucket" in line for line in windows)
    assert not any(line.split("], [")[1].count(",") < 2 for line in windows)
