"""Scores of both classifiers against a refit in plain Python, row by row."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from quern.llm import quality, toxicity
from tests.llm.conftest import words
from tests.llm.test_classifiers import good, junk


def sigmoid(t):
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, t))))


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def solve(a, b):
    """Gauss's elimination."""
    rows = [[*r, v] for r, v in zip(a, b)]
    n = len(rows)
    for k in range(n):
        top = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[top] = rows[top], rows[k]
        for i in range(n):
            if i != k:
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    return [rows[k][n] / rows[k][k] for k in range(n)]


def calibrated(raw, label):
    ones = sum(label)
    zeros = len(label) - ones
    size = sum(map(abs, raw)) / len(raw) + 1e-9
    goal = [(ones + 1) / (ones + 2) if y else 1 / (zeros + 2) for y in label]
    w = [0.0, 0.0]
    for _ in range(50):
        p = [sigmoid(w[0] * r / size + w[1]) for r in raw]
        x = [(r / size, 1.0) for r in raw]
        g = [sum((pk - gk) * xk[i] for pk, gk, xk in zip(p, goal, x)) + 1e-3 * w[i] for i in (0, 1)]
        h = [[sum(pk * (1 - pk) * xk[i] * xk[j] for pk, xk in zip(p, x)) + 1e-3 * (i == j) for j in (0, 1)] for i in (0, 1)]
        step = solve(h, g)
        w = [v - max(-5.0, min(5.0, s)) for v, s in zip(w, step)]
        if max(map(abs, step)) < 1e-8:
            break
    return w[0] / size, w[1]


def plain_measures(text):
    data = (text or "").encode()
    tokens = data.split()
    if not tokens:
        return [0.0] * 15
    n, w = len(data), len(tokens)
    upper = sum(0x41 <= c <= 0x5A for c in data)
    letters = upper + sum(0x61 <= c <= 0x7A or c >= 0x80 for c in data)
    lines = data.split(b"\n")
    marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    bare = [t for t in tokens if t.strip(marks) or any(c not in marks for c in t)]
    return [
        math.log1p(n), upper / max(letters, 1), sum(0x30 <= c <= 0x39 for c in data) / n,
        sum(c in b".,;:?'\"-()" for c in data) / n, sum(c in b"#$%&*+/<=>@[\\]^_`{|}~" for c in data) / n,
        data.count(b"!") / w, data.count(b"|") / w, sum(c >= 0x80 for c in data) / n, min((n - w) / w, 50.0),
        len(set(tokens)) / w, len({(a, b) for a, b in zip(tokens, tokens[1:])}) / max(w - 1, 1), len(set(lines)) / len(lines),
        math.log1p(w / len(lines)), letters / n, (w - len(bare)) / w,
    ]


def tiny(spark):
    rows, labels = [], []
    for k in range(48):
        text = junk(k) if k % 4 == 0 else good(k)
        if k % 6 == 0:
            text += " idiot" if k % 4 else " you idiot, zorkelan moron"
        if k % 8 == 3:
            text += " fool"
        rows.append((k, text))
        if k % 3:
            labels.append((k, int(k % 4 != 0), int(k % 6 == 4 or k % 8 == 3)))
    rows += [(100, None), (101, "")]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_quality_scores_equal_a_plain_refit(spark):
    rows, labels, docs, table = tiny(spark)
    x = {i: plain_measures(t) for i, t in rows}
    label = {i: q for i, q, _ in labels if not quality.is_held_out(i)}
    web = [x[i] for i, _ in rows if not quality.is_held_out(i)]
    mean = [sum(c) / len(web) for c in zip(*web)]
    scale = [math.sqrt(sum((v - m) ** 2 for v in c) / len(web)) + 1e-9 for c, m in zip(zip(*web), mean)]

    def wide(v):
        z = [max(-6.0, min(6.0, (a - m) / s)) for a, m, s in zip(v, mean, scale)]
        return [*z, *(a * a / 6 for a in z), 1.0]

    up, uu = [wide(x[i]) for i in label if label[i]], [wide(v) for v in web]
    prior = (sum(label.values()) + 1) / (len(label) + 2)
    w, m, v = [0.0] * 31, [0.0] * 31, [0.0] * 31
    for t in range(1, 601):
        def rising(points):
            s = [sigmoid(dot(p, w)) for p in points]
            g = [sum(a * (1 - a) * p[k] for a, p in zip(s, points)) / len(points) for k in range(31)]
            return sum(s) / len(s), g

        (rp, gp), (ru, gu) = rising(up), rising(uu)
        if ru - prior * rp >= 0:
            g = [b - 2 * prior * a for a, b in zip(gp, gu)]
        else:
            g = [prior * a - b for a, b in zip(gp, gu)]
        g = [a + 1e-3 * b for a, b in zip(g, w)]
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g)]
        v = [0.999 * a + 0.001 * b * b for a, b in zip(v, g)]
        w = [c - 0.05 * (a / (1 - 0.9**t)) / (math.sqrt(b / (1 - 0.999**t)) + 1e-8) for a, b, c in zip(m, v, w)]
    raw = {i: dot(wide(p), w) for i, p in x.items()}
    slope, offset = calibrated([raw[i] for i in label], [label[i] for i in label])
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, table).collect()}
    assert got == pytest.approx({i: sigmoid(slope * r + offset) for i, r in raw.items()}, abs=1e-4)


def plain_terms(text):
    out = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out |= {word + "$", *(word[:k] for k in range(3, min(8, len(word)) + 1))}
    return out


def plain_mined(rows, label):
    toxic, clean = Counter(), Counter()
    for i, t in rows:
        if i in label:
            (toxic if label[i] else clean).update(plain_terms(t))
    n1 = sum(label.values())
    share, ranked = n1 / len(label), []
    for term, a in toxic.items():
        b = clean[term]
        e = (a + b) * share
        g = 2 * (a * math.log(a / e) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0)) if a > e else 0
        if a >= 4 and a >= 2 * b and round(g, 9) >= 20:
            ranked.append((-round(g, 9), -len(term), term))
    chosen = list(toxicity.LEXICON)
    for _, _, term in sorted(ranked):
        bare = term.rstrip("$")
        if len(chosen) < len(toxicity.LEXICON) + 64 and not any(
            bare.startswith(c.rstrip("$")) or c.rstrip("$").startswith(bare) for c in chosen
        ):
            chosen.append(term)
    return chosen


def plain_hits(text, terms):
    found, hits = [0] * len(terms), 0
    tokens = re.findall(r"[^\W\d_]+", (text or "").lower())
    for word in tokens:
        at = [k for k, t in enumerate(terms) if (word == t[:-1] if t.endswith("$") else word.startswith(t))]
        hits += bool(at)
        for k in at:
            found[k] += 1
    return len(tokens), hits, found


def test_toxicity_scores_equal_a_plain_refit(spark):
    rows, labels, docs, table = tiny(spark)
    # enough rows for a mined term
    rows += [(200 + k, f"{words(k, 40)} {'zorkelix' if k % 3 == 0 else ''}") for k in range(60)]
    labels += [(200 + k, 1, int(k % 3 == 0)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    label = {i: t for i, _, t in labels if not quality.is_held_out(i)}
    terms = plain_mined(rows, label)
    assert len(terms) > len(toxicity.LEXICON)
    hit = {i: plain_hits(t, terms) for i, t in rows}

    def votes(n, h, c):
        share, kinds = h / max(n, 1), sum(v > 0 for v in c)
        shapes = [kinds >= 2, h >= 3, share >= 0.01, share >= 0.003]
        against = [h == 0, h == 1 and n > 600, share < 0.002]
        return [*(int(v > 0) for v in c), *map(int, shapes), *(-int(v) for v in against)]

    def features(n, h, c):
        return [
            *(min(v, 3) for v in c), math.log1p(h), math.log1p(1000 * h / max(n, 1)), math.log1p(sum(v > 0 for v in c)), math.log1p(n),
        ]

    web = [i for i, _ in rows if not quality.is_held_out(i)]
    vote = [votes(*hit[i]) for i in web]
    m = len(vote[0])

    def fit(parent, p):
        for _ in range(40):
            table, given = [], []
            for j in range(m):
                table.append([])
                given.append([])
                for c in (0, 1):
                    q = [pk if c else 1 - pk for pk in p]
                    n = [[0.0] * 3 for _ in range(3)]
                    for row, weight in zip(vote, q):
                        n[row[parent[j]] + 1 if parent[j] >= 0 else 1][row[j] + 1] += weight
                    own = [sum(r[v] for r in n) + 0.3 for v in range(3)]
                    own = [v / sum(own) for v in own]
                    table[j].append(own)
                    given[j].append([[(r[v] + 0.3 * own[v]) / (sum(r) + 0.3) for v in range(3)] for r in n])
            prior = min(0.5, max(1e-3, sum(p) / len(p)))

            def posterior(row):
                t = math.log(prior / (1 - prior))
                for j in range(m):
                    a = row[parent[j]] + 1 if parent[j] >= 0 else 1
                    t += math.log(given[j][1][a][row[j] + 1] / given[j][0][a][row[j] + 1])
                return sigmoid(t)

            new = [posterior(r) for r in vote]
            done = max(abs(a - b) for a, b in zip(new, p)) < 1e-6
            p = new
            if done:
                break
        return p

    p = [0.98 if sum(v == 1 for v in r) >= 2 else 0.02 for r in vote]
    information = [[0.0] * m for _ in range(m)]
    for i in range(m):
        for j in range(m):
            for c in (0, 1):
                n, n_i, n_j, total = Counter(), Counter(), Counter(), 0.0
                for row, pk in zip(vote, p):
                    q = pk if c else 1 - pk
                    n[row[i], row[j]] += q
                    n_i[row[i]] += q
                    n_j[row[j]] += q
                    total += q
                information[i][j] += sum(x * math.log(x * total / (n_i[a] * n_j[b])) for (a, b), x in n.items() if x > 0) / len(vote)
    parent, inside = [-1] * m, {0}
    while len(inside) < m:
        _, j, i = min((-round(information[i][j], 9), j, i) for i in inside for j in range(m) if j not in inside)
        parent[j] = i
        inside.add(j)
    soft = fit(parent, p)

    x = [features(*hit[i]) for i in web]
    mean = [sum(c) / len(x) for c in zip(*x)]
    scale = [math.sqrt(max(sum(v * v for v in c) / len(c) - a * a, 0)) + 1e-2 for c, a in zip(zip(*x), mean)]

    def wide(v):
        return [*((a - b) / s for a, b, s in zip(v, mean, scale)), 1.0]

    z = [wide(v) for v in x]
    d = len(z[0])
    w = [0.0] * d
    for _ in range(60):
        q = [sigmoid(dot(r, w)) for r in z]
        g = [sum((a - b) * r[k] for a, b, r in zip(q, soft, z)) / len(z) + 1e-2 * w[k] for k in range(d)]
        h = [[sum((a * (1 - a) + 1e-6) * r[k] * r[j] for a, r in zip(q, z)) / len(z) + 1e-2 * (k == j) for j in range(d)] for k in range(d)]
        step = solve(h, g)
        w = [a - b for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-9:
            break
    raw = {i: dot(wide(features(*hit[i])), w) for i, _ in rows}
    slope, offset = calibrated([raw[i] for i in label], [label[i] for i in label])
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, table).collect()}
    assert got == pytest.approx({i: sigmoid(slope * r + offset) for i, r in raw.items()}, abs=1e-3)
