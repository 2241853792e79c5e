"""Rates of the mixing stage against the exact least-squares optimum."""

from __future__ import annotations

import collections
import re

import numpy as np
import pytest

from triplane.llm import mixing, queries


def solved(n, p, wanted):
    price, reached, best = mixing.solve(lambda x: mixing._sums(n, p, x), wanted, 60, 1e-3)
    rate = mixing._rates(p, price)
    assert (n * rate) @ p == pytest.approx(reached)
    return rate, reached, best


@pytest.mark.parametrize("low", [1e-2, 1e-3, 3e-4, 1e-4])
def test_rare_domains(low):
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 200_000, p=[0.88 - low, low, 0.12])
    n = rng.integers(1, 800, len(kind)).astype(float)
    wanted = np.array([0.95, 0.04, 0.01]) * n.sum()
    hard = np.eye(3)[kind]
    noise = rng.dirichlet([0.2, 0.2, 0.2], len(kind))
    for p in (hard, 0.98 * hard + 0.02 * noise):
        rate, reached, best = solved(n, p, wanted)
        assert best and (rate >= 0).all()
        assert reached == pytest.approx(wanted, rel=1e-3)


def test_out_of_reach():
    """The nearest totals of a cone, found here by its edges."""
    n, p = np.array([100.0, 50.0, 70.0]), np.array([[0.9, 0.1], [0.7, 0.3], [0.8, 0.2]])
    wanted = np.array([10.0, 200.0])
    rate, reached, best = solved(n, p, wanted)
    edge = p[1] * max(0.0, p[1] @ wanted) / (p[1] @ p[1])
    assert best and (rate >= 0).all() and reached == pytest.approx(edge, rel=1e-3)


def exact_nonnegative(n, p, wanted):
    """Least squares over nonnegative rates by trying the sets of rows that may be active (extreme rays of a cone)."""
    from itertools import combinations

    a = (p * n[:, None]).T
    best = (np.inf, None)
    for k in range(1, p.shape[1] + 1):
        for rows in combinations(range(len(n)), k):
            x, *_ = np.linalg.lstsq(a[:, rows], wanted, rcond=None)
            if (x >= -1e-12).all():
                left = a[:, rows] @ x
                best = min(best, (float(((left - wanted) ** 2).sum()), tuple(left)))
    return best


@pytest.mark.parametrize("share", [0.05, 0.5, 0.95])
def test_small_problems(share):
    """The totals of the rates are those of an exact nonnegative least-squares solution."""
    rng = np.random.default_rng(int(share * 100))
    for _ in range(5):
        n, p = rng.integers(5, 90, 9).astype(float), rng.dirichlet([0.6, 0.6, 0.3], 9)
        wanted = np.array([1 - share, share * 0.7, share * 0.3]) * n.sum()
        rate, reached, best = solved(n, p, wanted)
        error, totals = exact_nonnegative(n, p, wanted)
        assert best and (rate >= 0).all()
        assert ((reached - wanted) ** 2).sum() <= error + 1e-4 * wanted.sum() ** 2 * 1e-2
        assert reached == pytest.approx(np.array(totals), abs=2e-3 * wanted.sum())


def test_held_out_recall(spark):
    """The classifier finds each domain in documents it was not fitted on."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, sf_dir, "documents"), queries.label_domains(queries.table(spark, sf_dir, "labels"))
    fitted = labels.where("doc_id % 2 = 0")
    out = {r.doc_id: r for r in mixing.mix(docs, fitted, queries.TARGETS).collect()}
    found = [(r.domain, out[r.doc_id].domain) for r in labels.where("doc_id % 2 = 1").collect()]
    recall = {k: np.mean([b == k for a, b in found if a == k]) for k in ("clean", "low", "toxic")}
    print(recall)
    assert recall["clean"] >= 0.95 and recall["toxic"] >= 0.8 and recall["low"] >= 0.8
    totals = np.sum([r.rate * r.n_tokens * np.array(r.posterior) for r in out.values()], axis=0)
    wanted = np.array([queries.TARGETS[k] for k in sorted(queries.TARGETS)]) * sum(r.n_tokens for r in out.values())
    assert totals == pytest.approx(wanted, rel=2e-3)
    rates = {k: np.mean([r.rate for r in out.values() if r.domain == k]) for k in recall}
    assert rates["toxic"] < 0.5 < 1 < min(rates["clean"], rates["low"])


def features(t):
    """What a document holds: words, shapes and prefixes, at all and twice or more."""
    kind = lambda c: "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or c > "~" else "0" if "0" <= c <= "9" else c
    shape = lambda w: re.sub("([Aa0])\\1+", "\\1", "".join(map(kind, w)))
    held = collections.Counter(x for w in (t or "").split() for x in (("w", w.lower()), ("s", shape(w)), ("p", w.lower().encode()[:6])))
    return {(x, 1) for x in held} | {(x, 2) for x, n in held.items() if n > 1}


def test_posteriors_against_brute_force(spark):
    """The features used are those with the evidence, and the weights the optimum of the penalised likelihood."""
    rng = np.random.default_rng(8)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 60, k))
    rows = [(i, "a", word(30) + " reddish" * int(rng.random() < 0.8)) for i in range(80)] + [(100 + i, "b", word(30) + " BLUE! é" * int(rng.random() < 0.7)) for i in range(60)]
    more = [(300, None, None), (301, None, ""), (302, None, "reddish BLUE!"), (303, None, "REDDISH reddest red")]
    docs = spark.createDataFrame(rows + more, "doc_id long, domain string, text string")
    out = {r.doc_id: r for r in mixing.mix(docs.select("doc_id", "text"), docs.select("doc_id", "domain"), {"a": 0.5, "b": 0.5}).collect()}
    sets, y = [features(t) for _, _, t in rows], np.array([d == "b" for _, d, _ in rows])
    n, used = np.array([80.0, 60.0]), []
    for x in sorted(set().union(*sets), key=str):
        c = np.array([sum(x in s for s, b in zip(sets, y, strict=True) if b == k) for k in (False, True)], float)
        e = n * c.sum() / n.sum()
        if sum(2 * a * np.log(a / m) for a, m in (*zip(c, e, strict=True), *zip(n - c, n - e, strict=True)) if a) >= 12:
            used.append(x)
    assert {("w", "reddish"), ("w", "blue!"), ("s", "A!"), ("p", b"reddis")} <= {x for x, _ in used}
    brute = np.array([[x in s for x in used] + [True] for s in sets], float)
    w = np.zeros(brute.shape[1])  # two domains: a plain logistic regression with half the penalty, by Newton steps
    penalty = np.append(np.full(len(used), 0.25), 5e-4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-brute @ w))
        w -= np.linalg.solve((brute.T * (p * (1 - p))) @ brute + np.diag(penalty), brute.T @ (p - y) + penalty * w)
    for k, _, t in rows + more:
        own = features(t)
        assert out[k].posterior[1] == pytest.approx(1 / (1 + np.exp(-(w[-1] + sum(v for x, v in zip(used, w, strict=False) if x in own)))), abs=2e-3)


def test_unreached_targets_warn(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "clean")], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="out of reach"):
        mixing.mix(rows, labels, {"clean": 0.0, "toxic": 1.0}).collect()
