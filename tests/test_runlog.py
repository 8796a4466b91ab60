import json
import random

import pytest

from corpuskit.operators import runlog
from corpuskit.sources import readers


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(4)
    rows = []
    for run, size in (("a", 1), ("b", 2), ("c", 3), ("d", 57), ("hot", 400)):
        steps = sorted(rng.sample(range(1000), size))
        rows += [(run, s, round(rng.uniform(0, 9), 1)) for s in steps]
    return spark.createDataFrame(rows, "run string, step int, loss double").cache()


def by_run(logs):
    out = {}
    for r in logs.orderBy("run", "step").collect():
        out.setdefault(r.run, []).append((r.step, r.loss))
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 16, 100, 10000])
def test_new_best_and_spike_do_not_depend_on_blocks(logs, width):
    best = {(r.run, r.step): (r.prev_best, r.is_best) for r in runlog.new_best(logs, width=width).collect()}
    spikes = {(r.run, r.step): (r.prev1, r.prev2, r.is_spike) for r in runlog.spike(logs, width=width).collect()}
    assert len(best) == len(spikes) == logs.count()
    for run, entries in by_run(logs).items():
        losses = [x for _, x in entries]
        for t, (step, loss) in enumerate(entries):
            earlier = min(losses[:t]) if t else None
            assert best[(run, step)] == (earlier, int(t > 0 and earlier > loss))
            p1 = losses[t - 1] if t > 0 else None
            p2 = losses[t - 2] if t > 1 else None
            jump = t > 1 and loss - p1 > abs(p1 - p2)
            assert spikes[(run, step)] == (p1, p2, int(jump))


def test_every(logs):
    assert {r.step % 12 for r in runlog.every(logs, 12).collect()} == {0}
    assert {(r.step + 1) % 7 for r in runlog.every(logs, 7, shift=1).collect()} == {0}


def test_summary_ranks_trials(spark, logs):
    configs = spark.createDataFrame([(r, 0.1) for r in "abcd"] + [("hot", 0.2)], "run string, max_lr double")
    got = {r.run: r for r in runlog.trial_summary(logs, configs).collect()}
    runs = by_run(logs)
    order = sorted(runs, key=lambda r: (min(x for _, x in runs[r]), r))
    assert [got[r]["rank"] for r in order] == [1, 2, 3, 4, 5]
    assert got["hot"].last_loss == runs["hot"][-1][1] and got["hot"].max_lr == 0.2


def test_logs_and_configs_from_files(spark, tmp_path):
    for i, losses in enumerate([[3.5, 2.0], [1.0], []]):
        (tmp_path / f"t{i}").mkdir()
        (tmp_path / f"t{i}" / "loss.json").write_text(json.dumps(losses))
        (tmp_path / f"t{i}" / "config.json").write_text(json.dumps({"max_lr": i / 10}, indent=4))
    rows = readers.load_loss_log(spark, f"{tmp_path}/*/loss.json").collect()
    assert sorted((r.run.split("/")[-2], r.step, r.loss) for r in rows) == [("t0", 0, 3.5), ("t0", 1, 2.0), ("t1", 0, 1.0)]
    configs = readers.load_trial_configs(spark, f"{tmp_path}/*/config.json", "max_lr double").collect()
    assert sorted((r.run.split("/")[-2], r.max_lr) for r in configs) == [("t0", 0.0), ("t1", 0.1), ("t2", 0.2)]


def test_null_runs_and_runs_without_configuration_stay(spark):
    logs = spark.createDataFrame([(None, 0, 2.0), (None, 1, 1.0), ("a", 0, 3.0)], "run string, step int, loss double")
    assert [(r.run, r.is_best) for r in runlog.new_best(logs).orderBy("run", "step").collect()] == [(None, 0), (None, 1), ("a", 0)]
    configs = spark.createDataFrame([("b", 1.0)], "run string, max_lr double")
    assert [(r.run, r.max_lr, r.n_steps) for r in runlog.trial_summary(logs, configs).orderBy("rank").collect()] == [
        (None, None, 2), ("a", None, 1),
    ]
