"""Language evidence and toxicity weights against plain readings of their formulas."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import language_id as L
from lodestone.llm import toxicity as T

WORDS = {"en": "the of and this with some other people there about which", "de": "der die und nicht eine sich auch nach werden über straße", "fr": "le la les une dans pour être avec été où garçon"}


def say(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def records():
    r = random.Random(8)
    rows = []
    for i in range(54):
        lang = r.choice(list(WORDS))
        declared = r.choice([lang, lang, lang, None, "EN", "x1", "fr-CA"])
        host = r.choice([None, "", "localhost", "a.example.de", "b.example.de", "news.site.fr", "site.fr", "www.paper.uk"])
        rows.append((i, say(r, lang, r.choice([1, 2, 4, 12, 40])), declared, host))
    rows += [(100, None, "en", "site.fr"), (101, "12 + 7", "de", "a.example.de"), (102, "qqxj zzkw vvpq " * 5, None, None), (103, rows[0][1], rows[0][2], rows[0][3])]
    rows += [(103, say(r, "en", 3), "en", "b.example.de")]
    return rows


def code(value):
    c = (value or "").strip().split("-")[0].split("_")[0].lower()
    return c if c.isascii() and c.isalpha() and 2 <= len(c) <= 3 else None


def levels(host):
    labels = (host or "").lower().split(".")
    dotted = len(labels) > 1
    return {"suffix": labels[-1] if dotted else None, "domain": ".".join(labels[-2:]) if dotted else None, "host": host.lower() if host else None}


def plain_fusion(rows):
    """The posterior of every record, from counts that leave it out."""
    counts = collections.Counter(code(d) for _, t, d, _ in rows if code(d) and t)
    names = sorted(k for k, n in counts.items() if n >= L.LEAST_TEXTS)
    grams = [collections.Counter(b for _, at in L.trigrams([t]) for b in at.tolist()) for _, t, _, _ in rows]
    model = {k: sum((g for g, (_, t, d, _) in zip(grams, rows, strict=True) if t and code(d) == k), collections.Counter()) for k in names}
    seen = []
    for g, (_, _, d, host) in zip(grams, rows, strict=True):
        n = sum(g.values())
        temper = min(n, L.EFFECTIVE) / max(n, 1)
        ll = {k: temper * sum(c * math.log((model[k][b] + L.PSEUDO) / (model[k].total() + L.PSEUDO * L.BUCKETS)) for b, c in g.items()) for k in names}
        chance = -temper * n * math.log(L.BUCKETS)
        best = max(names, key=lambda k: (ll[k], -names.index(k)))
        known = n > 0 and ll[best] >= chance + math.log(L.BACKGROUND)
        seen.append((ll, chance, n, best if known else None, {"declared": code(d), **levels(host)}))
    tally = collections.Counter((by, e[by], best) for *_, best, e in seen for by in L.EVIDENCE if best and e[by] is not None)
    total = collections.Counter(best for *_, best, _ in seen if best)
    values = {by: len({v for b, v, _ in tally if b == by}) for by in L.EVIDENCE}
    out = []
    for ll, chance, n, best, e in seen:
        own = lambda k: best == k  # noqa: B023,E731
        there = {by: e[by] is not None and any(tally[by, e[by], k] for k in names) for by in L.EVIDENCE}
        prior = {k: (total[k] + L.PSEUDO) / (total.total() + L.PSEUDO * len(names)) for k in names}
        for by in ("suffix", "domain", "host"):
            if there[by]:
                many = sum(tally[by, e[by], k] for k in names) - (best is not None)
                prior = {k: (tally[by, e[by], k] - own(k) + L.KAPPA * prior[k]) / (many + L.KAPPA) for k in names}
        log = {k: ll[k] + math.log(prior[k]) for k in names} | {None: chance + math.log(L.BACKGROUND)}
        for by in ("declared", "suffix"):
            if there[by]:
                for k in names:
                    log[k] += math.log((tally[by, e[by], k] - own(k) + L.PSEUDO) / (total[k] - own(k) + L.PSEUDO * (values[by] + 1)))
                log[None] -= math.log(values[by] + 1)
        top = max(log, key=log.get)
        out.append((top, 1 / sum(math.exp(x - log[top]) for x in log.values())) if n else (None, 0.0))
    return out


def test_posteriors(spark):
    rows = records()
    table = spark.createDataFrame([(i, t, d, h, len(t or "")) for i, t, d, h in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.lang, r.confidence) for r in L.identify(L.document_evidence(table)).collect()), key=lambda r: (r[0], r[2]))
    want = sorted(((row[0], lang, p) for row, (lang, p) in zip(rows, plain_fusion(rows), strict=True)), key=lambda r: (r[0], r[2]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    np.testing.assert_allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-4)  # the model is kept in single precision
    assert {lang for _, lang, _ in want} == {None, "de", "en", "fr"}


def test_a_rare_code_is_no_language(spark):
    r = random.Random(4)
    rows = [(i, say(r, lang, 4000), lang, None) for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(900 + i, "4815 x 162342 q q q jk", "qq", None) for i in range(L.LEAST_TEXTS - 1)]
    rows += [(960, say(r, "de", 30), "zz", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: (x.lang, x.accepted) for x in L.identify(L.document_evidence(table)).collect()}
    assert not any(got[i][1] for i in range(900, 900 + L.LEAST_TEXTS - 1))
    assert got[960] == ("de", True)  # a wrong code doesn't spoil a good text
    assert all(got[i] == (lang, True) for i, _, lang, _ in rows[:40])
    few = table.filter("doc_id < 8").withColumn("lang", F.concat(F.lit("q"), F.substring("lang", 1, 1)))
    assert not any(x.accepted for x in L.identify(L.document_evidence(few)).collect())


def plain_ftrl(examples):
    """Weights by coordinate and the bias, one example after another."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        l1 = 0.0 if k == "bias" else T.L1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((T.BETA + math.sqrt(n[k])) / T.ALPHA + T.L2)

    for _ in range(T.EPOCHS):
        for coordinates, label in examples:
            w = {k: weight(k) for k in [*coordinates, "bias"]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for k, x in w.items():
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / T.ALPHA * x
                n[k] += g * g
    return {k: w for k in z if (w := weight(k)) and k != "bias"}, weight("bias")


def coordinates(text):
    """Words, pairs and skip pairs of a text, as the operator hashes each of them alone."""
    row, at = T.features([text])
    return sorted(set(at.tolist()))


def plain_scores(texts, labels):
    """Scores of all texts: fitted on those that aren't held out, but for each fifth one, which sets the threshold."""
    known = [i for i in labels if zlib.crc32(str(i).encode()) % T.FOLDS]
    order = sorted(known, key=lambda i: (int(T.mix64(np.array([i], np.uint64))[0]), i))
    check = order[:: T.CALIBRATION]
    w, bias = plain_ftrl([(coordinates(texts[i]), labels[i]) for i in order if i not in check])
    raw = {i: bias + sum(w.get(k, 0.0) for k in coordinates(t)) for i, t in texts.items()}
    cuts = sorted({raw[i] for i in check}, reverse=True)
    best = []
    for a, b in zip(cuts, cuts[1:]):
        said = [i for i in check if raw[i] >= a]
        f1 = 2 * sum(labels[i] for i in said) / (len(said) + sum(labels[i] for i in check))
        best.append((f1, a - b, (a + b) / 2))
    top = max(f for f, _, _ in best)
    cut = max((gap, at) for f, gap, at in best if f == top)[1]
    return {i: 1 / (1 + math.exp(-(x - cut))) for i, x in raw.items()}, len(w)


def toxic_texts():
    r = random.Random(11)
    bad, plain = ["idiot", "you fool", "stupid thing", "shut up"], "some words about a garden with trees and a river that runs slowly".split()
    texts, labels = {}, {}
    for i in range(240):
        words = [r.choice(plain) for _ in range(r.randint(3, 25))]
        labels[i] = int(r.random() < 0.4)
        for _ in range(3 * labels[i]):
            words.insert(r.randrange(len(words)), r.choice(bad))
        texts[i] = " ".join(words)
    return texts, labels


def test_ftrl_weights():
    texts, labels = toxic_texts()
    sets, counts = T.feature_sets(list(texts.values()))
    cut = np.append(0, np.cumsum(counts))
    at, w, bias = T.ftrl([sets[a:b] for a, b in zip(cut, cut[1:])], np.array([float(x) for x in labels.values()]))
    want, plain_bias = plain_ftrl([(coordinates(t), labels[i]) for i, t in texts.items()])
    assert sorted(want) == at.tolist() and len(at) > 5
    np.testing.assert_allclose(w, [want[k] for k in at.tolist()], rtol=1e-9)
    assert math.isclose(bias, plain_bias, rel_tol=1e-9)


def test_toxic_scores(spark):
    texts, labels = toxic_texts()
    want, many = plain_scores(texts, labels)
    rows = [*texts.items(), *([(7, texts[7])] * 3), (7, "")]  # an id that repeats is learned from once
    got = T.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    first = {r.doc_id: r.score for r in got if not (r.doc_id == 7)}
    assert len(got) == len(rows) and many > 5
    np.testing.assert_allclose([first[i] for i in first], [want[i] for i in first], rtol=1e-7)
    assert sorted(round(r.score, 9) for r in got if r.doc_id == 7)[-4:].count(round(want[7], 9)) >= 4
    held = [i for i in texts if zlib.crc32(str(i).encode()) % T.FOLDS == 0]
    assert sum((first.get(i, want[7]) >= 0.5) == bool(labels[i]) for i in held) >= 0.9 * len(held)
