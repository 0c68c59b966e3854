"""Keyed state over restarts gives what one batch over all lines gives."""

import json
import random

from verilane.streaming import keyed, verdicts


def test_restarts_and_late_lines(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    rng, lines, progress = random.Random(1), [], keyed.Progress()
    spark.streams.addListener(progress)
    try:
        for k in range(3):
            rows = [(rng.choice(["c1", "c2", "c3", f"d{k}"]), rng.choice(["v1", "v2"]), rng.choice(["partial", "supported", None]), rng.randrange(1000)) for _ in range(30)]
            lines += rows
            (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("claim_id", "prompt_version", "support", "line"), r, strict=True))) for r in rows))
            query = keyed.keep_last(verdicts.verdict_stream(spark, str(source)), checkpoint, target)  # begins where the last one ended
            query.awaitTermination()
            want = {}
            for c, p, s, n in lines:
                if (c, p) not in want or n > want[c, p][1]:
                    want[c, p] = (s, n)
            got = {(r.claim_id, r.prompt_version): (r.support, r.line) for r in keyed.current(spark, checkpoint).collect()}
            assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
            assert all(got[k] == want[k] or sum(n == v[1] and (c, p) == k for c, p, _, n in lines) > 1 for k, v in want.items())
        assert spark.read.parquet(target).count() >= len(want)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(progress)
    assert sum(rows for _, _, rows in progress.batches) == len(lines) and progress.ended == [None] * 3
