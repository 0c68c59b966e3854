"""The citation stream against a plain loop over the same citations."""

import random

from verilane.operators import citestream


def test_fold_equals_a_plain_loop(spark):
    rng = random.Random(6)
    cases = [("Smith", "Jones", 100, "F.3d", 5), ("Adams Corp.", "Baker", 88, "F. Supp. 2d", 12), ("Doe", "Smith", 100, "F.3d", 77), ("Cole", "State of Ohio", 410, "U.S.", 113)]
    docs, want = [], {}
    for d in range(40):
        text, fulls, last, seen = [], [], None, set()
        for ord_ in range(rng.randrange(12)):
            p, q, vol, rep, page = rng.choice(cases)
            kind = rng.choice(["full", "short", "supra", "id"])
            if kind == "full":
                text.append(f"See {p} v. {q}, {vol} {rep} {page} (finding this).")
                target = f"{vol} {rep} {page}"
                fulls.append((p.split()[0].lower(), q.split()[0].lower(), vol, rep, target))
            elif kind == "short":
                text.append(f"But see {vol} {rep} at 9.")
                target = next((f[4] for f in reversed(fulls) if (f[2], f[3]) == (vol, rep)), None)
            elif kind == "supra":
                name = rng.choice([p, q])
                text.append(f"See {name}, supra, at 3.")
                target = next((f[4] for f in reversed(fulls) if name.split()[0].lower() in f[:2]), None)
            else:
                text.append("Id. at 4.")
                target = last
            last = target
            want[d, ord_] = (kind, target, target is not None and target in seen)
            seen.add(target)
        docs.append((d, " Plain words. ".join(text)))
    docs += [(100, None), (101, "")]
    got = {(r.d, r.ord): (r.kind, r.target, r.again) for r in citestream.resolved(spark.createDataFrame(docs, "d int, text string"), "d", "text").collect()}
    assert got == want
    rates = {r.d: r for r in citestream.rates(spark.createDataFrame(docs, "d int, text string"), "d", "text").collect()}
    for d, r in rates.items():
        own = [v for (e, _), v in want.items() if e == d]
        assert (r.n_cites, r.n_id, r.unresolved, r.targets) == (len(own), sum(v[0] == "id" for v in own), sum(v[1] is None for v in own), len({v[1] for v in own} - {None}))
        assert r.repeat_rate == round(sum(v[2] for v in own) / len(own), 3)
