"""URL filters, toxicity, decontamination and personal data."""

import collections
import hashlib
import itertools
import math
import random
import re
import time

import pytest

from formline.llm import decontam, pii, toxicity, url_rules
from formline.llm.queries import HOST_RULES


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.Example.NET/en/3?x#y", "a.example.net", "/en/3", "example.net/en/", "allow"),
        ("http://example.net/fr/1", "example.net", "/fr/1", "net/", "block"),
        ("http://b.example.com/de/#t", "b.example.com", "/de/", "example.com/de/", "block"),
        ("http://b.example.com/den", "b.example.com", "/den", None, "allow"),
        ("x://site.org/fr/?q", "site.org", "/fr/", "org/fr/", "allow"),
        ("http://net", "net", "", None, "allow"),
        ("http://mynet/", "mynet", "/", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_host_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "rule array<string>, confidence double, support double, key string")
    r = url_rules.judge(pages, HOST_RULES, none).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_mined_rules(spark):
    rows = [(f"http://spam{i % 3}.test/win/{i}", True) for i in range(60)] + [(f"http://site{i}.test/win/page{i}", False) for i in range(200)] + [("http://x.test/", None), (None, False)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = url_rules.mine(labelled)
    rules = {tuple(r.rule): r for r in mined.collect()}
    assert {("spam0",), ("spam1",), ("spam2",)} <= set(rules)
    assert not any(len(k) > 1 and set(k) & {"spam0", "spam1", "spam2"} for k in rules)  # superfluous ones are pruned
    pages = spark.createDataFrame([(1, "http://spam1.test/new"), (2, "http://fine.test/"), (1, "http://spam1.test/new")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.mined_rule) for r in url_rules.judge(pages, [], mined).collect()) == [(1, "block", "spam1"), (1, "block", "spam1"), (2, "allow", None)]
    assert url_rules.mine(labelled.limit(0)).count() == 0
    assert url_rules.judge(pages.limit(0), HOST_RULES, mined).count() == 0


def brute_rules(rows, min_support=0.0005, min_confidence=0.5, min_count=5, chance=0.05):
    """All sets of the labelled urls' items, judged by definition."""
    baskets = [(frozenset(re.findall("[a-z0-9]+", u or "")), bad) for u, bad in {(u or "", bad) for u, bad in rows if bad is not None}]
    n, bad = len(baskets), sum(b for _, b in baskets)
    least = max(min_count, math.ceil(min_support * n))
    cover, tried = collections.defaultdict(list), 0
    for token in sorted({x for t, _ in baskets for x in t}):
        urls = frozenset(i for i, (t, _) in enumerate(baskets) if token in t)
        if sum(baskets[i][1] for i in urls) >= least and len(urls) < n:
            cover[urls].append(token)
        elif len(urls) >= least and sum(baskets[i][1] for i in urls) < least:
            tried += 1
    items = {tuple(tokens): urls for urls, tokens in cover.items()}
    urls_of = {}
    for k in range(1, 7):
        for some in itertools.combinations(sorted(items), k):
            urls = frozenset.intersection(*(items[x] for x in some))
            if len(urls) >= least and all(urls_of.get(some[:i] + some[i + 1 :], set()) > urls for i in range(k) if k > 1):
                urls_of[some] = urls
    tried += len(urls_of)
    kept = {}
    for some, urls in urls_of.items():
        k, base = sum(baskets[i][1] for i in urls), bad / n
        c = k / len(urls)
        if k >= least and c >= min_confidence and c > base:
            kl = c * math.log(c / base) + ((1 - c) * math.log((1 - c) / (1 - base)) if c < 1 else 0)
            if len(urls) * kl >= math.log(tried / chance):
                kept[some] = c
    kept = {some: c for some, c in kept.items() if not any(set(p) < set(some) and q >= c for p, q in kept.items())}
    return {tuple(sorted(x for item in some for x in item)): c for some, c in kept.items()}


@pytest.mark.parametrize("most_items", [14, 1])
def test_mining_and_matching_equal_brute_force(spark, most_items):
    rnd = random.Random(41)
    word = lambda: rnd.choice(["win", "bets", "news", "blog", "shop", "pills", "a1", "b2"])
    rows = []
    for i in range(400):
        url = f"http://{word()}.{word()}/{word()}"
        bad = ("bets" in url and "win" in url) or ("pills" in url and rnd.random() < 0.8) or rnd.random() < 0.1
        rows.append((url, bad))
    rows += [(None, True), ("", False), ("http://x", None), (rows[0][0], rows[0][1])]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), most_items=most_items)
    rules = brute_rules(rows)
    got = {tuple(r.rule): r.confidence for r in mined.collect()}
    assert {k: pytest.approx(v) for k, v in got.items()} == rules and ("pills",) in got and ("bets", "win") in got
    pages = [(i, u) for i, (u, _) in enumerate(rows)] + [(900, "HTTP://PILLS.x/" + "y" * 100_000), (None, "http://win.bets/")]
    judged = url_rules.judge(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, host string"), [], mined).collect()
    assert len(judged) == len(pages)
    urls = dict(pages)
    for r in judged:
        tokens = set(re.findall("[a-z0-9]+", (urls[r.page_id] or "").lower()))
        fit = [(c, list(k)) for k, c in rules.items() if set(k) <= tokens]
        assert r.verdict == ("block" if fit else "allow") and r.mined_rule == ("+".join(max(fit)[1]) if fit else None)


def test_long_urls_are_mined_in_seconds(spark):
    """A bad url of 40 tokens under one template, nested hosts and paths, and copies of one url."""
    bad = [("http://evil.test/" + "/".join(f"t{k}" for k in range(38)) + f"/{i}", True) for i in range(8)]
    nested = [("http://deep.example/" + "/".join(f"d{k}" for k in range(30 - i)), True) for i in range(16)]
    copied = [("http://one.example/only/this/one", True)] * 50
    good = [(f"http://good{i}.example/page/{i}", False) for i in range(300)]
    began = time.time()
    got = {tuple(r.rule): r for r in url_rules.mine(spark.createDataFrame(bad + nested + copied + good, "url string, bad boolean")).collect()}
    assert time.time() - began < 60
    (template,) = [k for k in got if "evil" in k]
    assert len(template) == 40 and got[template].confidence == 1.0
    assert any("deep" in k for k in got) and not any("only" in k for k in got)


def test_chance_makes_no_rules(spark):
    """Labels that don't depend on the url: some token sets look bad, but none is kept."""
    rnd = random.Random(42)
    rows = [(f"http://w{rnd.randint(0, 60)}.test/{rnd.randint(0, 60)}", rnd.random() < 0.26) for _ in range(1000)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert url_rules.mine(df, chance=1e9).count() > 0 and url_rules.mine(df).count() == 0


def labelled_texts(n=400):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bcdfglmnprt") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot,", "SCUM", "moron***", "klutz" + word(), "É" + "clat"]))
        rows.append((i, " ".join(words), int(toxic), int(i % 4 > 0)))
    return rows


def test_toxicity_held_out(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in rows[:300]] + [(1, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(docs, labels, ["quality", "toxic"])
    assert [len(k.earlier) for k in chain.links] == [0, 1]
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, chain).collect()}
    held = [(x, got[i]) for i, _, x, _ in rows[300:]]
    assert sum(g for x, g in held if x) >= 0.9 * sum(x for x, _ in held) and not any(g for x, g in held if not x)
    kept = toxicity.clean(docs.union(spark.createDataFrame([(None, None)], docs.schema)), chain)
    assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if not g} | {None}


def test_logistic_regression_is_at_its_optimum():
    import numpy as np

    rng = np.random.default_rng(4)
    marks, rest = rng.random((300, 5)) < 0.4, rng.random((300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(marks[:, 0] * 2.0 - rest[:, 1])))).astype(float)
    rows = np.arange(0, 300, 2)
    w = toxicity._logistic(marks, rest, y, rows)
    x = np.hstack([marks, rest, np.ones((300, 1))])[rows]
    penalty = np.r_[np.full(7, 0.1), 1e-6]

    def loss(v):
        z = x @ v
        return (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y[rows]).sum() + (penalty * v * v).sum() / 2

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in np.vstack([np.eye(8), -np.eye(8)]) * 0.01)


def test_later_links_see_earlier_probabilities(spark):
    """The chain by definition: a dense model of each link over word beginnings, fed with out-of-fold probabilities."""
    import numpy as np

    rows = labelled_texts(200)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in rows] + [(0, 0, 0)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(docs, labels, ["quality", "toxic"])
    first, second = chain.links
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").collect()]
    texts, marks = {i: t.encode() for i, t, _, _ in rows}, []
    of = lambda link: [(k, w) for k, ws in link.words.items() for w in ws]
    dense = lambda link: np.array([[w in toxicity.features_of(texts[i])[k] for k, w in of(link)] for i in order])
    y = np.array([next(q for d, _, _, q in rows if d == i) for i in order], float)
    folds, held = np.arange(len(order)) % toxicity.FOLDS, np.zeros(len(order))
    none = np.zeros((len(order), 0))
    for f in range(toxicity.FOLDS):
        part = toxicity._logistic(dense(first), none, y, np.flatnonzero(folds != f))
        held[folds == f] = (1 / (1 + np.exp(-(np.hstack([dense(first), np.ones((len(order), 1))]) @ part))))[folds == f]
    toxic = np.array([next(x for d, _, x, _ in rows if d == i) for i in order], float)
    w = toxicity._logistic(dense(second), held[:, None], toxic, np.arange(len(order)))
    assert second.earlier == [pytest.approx(w[-2], rel=1e-3, abs=1e-4)] and second.intercept == pytest.approx(w[-1], rel=1e-3, abs=1e-4)
    for i in order[:20]:
        p = [1 / (1 + math.exp(-(link.intercept + sum(link.words[k][v] for k, v in of(link) if v in toxicity.features_of(texts[i])[k]) + extra))) for link, extra in [(first, 0.0)]]
        z = second.intercept + second.earlier[0] * p[0] + sum(second.words[k][v] for k, v in of(second) if v in toxicity.features_of(texts[i])[k])
        assert chain.probabilities(texts[i]) == pytest.approx([p[0], 1 / (1 + math.exp(-z))], rel=1e-6)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x", 1), (3, "w " * 200_000, 1), (3, "w " * 20000, 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels, ["toxic"])
    assert [r.toxic for r in toxicity.score(docs, chain).collect()] == [False] * 5
    one_class = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"), ["toxic"])
    assert toxicity.score(docs.limit(0), one_class).count() == 0


def test_common_subsequence():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(100):
        a, b = ([rnd.randint(-1, 4) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y != -1 else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_leaks(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bcdfglmnprt") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [f"{prose(rnd.randint(8, 30))}. {prose(rnd.randint(6, 12))}." for _ in range(40)]
    swapped = items[3].split()
    swapped[2], swapped[9] = word(), word()
    docs = {
        1: f"{prose(300)} {items[0]} {prose(200)}",
        2: items[1].upper(),
        3: f"{prose(70)} {items[2].replace(' ', ' *** ')}",
        4: f"{prose(40)} {' '.join(swapped)} {prose(500)}",
        5: prose(400),
        6: f"{prose(100)} {' '.join(items[5].split()[:4])} {prose(100)}",
        7: None,
        8: "",
    }
    frame = spark.createDataFrame([(d, t, 0.0) for d, t in docs.items()] + [(1, docs[1], 0.0), (None, docs[5], 0.0)], "doc_id long, text string, share double")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, items[0])], "item_id long, text string")
    got = decontam.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.contaminated} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert all(r.n_items == 2 for r in got if r.doc_id == 1)  # the repeated passage counts for both ids
    assert len(decontam.clean(frame, bench).collect()) == 5
    assert decontam.leaks(frame, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.leaks(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 6, 20, 200, 1000])
def test_verbatim_copies_of_any_length(spark, n):
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("bcdfglmnprt") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(n) for _ in range(6)]
    docs = [(k, f"{prose(37 + 5 * k)} {items[k]} {prose(90)}") for k in range(5)] + [(9, prose(400))]
    if n >= 200:
        changed = items[5].split()
        changed[7::9] = [word() for _ in changed[7::9]]
        docs.append((5, f"{prose(50)} {' '.join(changed)} {prose(70)}"))
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.contaminated} == {(d, d) for d, _ in docs if d != 9}
    assert all(r.share == 1 for r in got if r.doc_id < 5)


def made(items, docs, **settings):
    """The Finder of passages whose words all weigh the same."""
    import numpy as np

    rows = [(k, decontam.words([t])[0], decontam.words([decontam.answer_of(t)])[0]) for k, t in enumerate(items)]
    columns = np.unique(np.concatenate([w for _, w, _ in rows]) % np.uint64(decontam.WIDTH))
    return decontam.Finder(decontam.Space(columns, np.ones(len(columns)), np.eye(len(columns))), rows, **({"cosine": 0.45, "overlap": 0.6, "answer": 0.5} | settings))


def test_repeated_words_reach_the_bound():
    import numpy as np

    finder = made([b"salt " * 12 + b"water"], [])
    text = [b"salt " * 5 + b"a b c d e f g h i j k l m n o p q r s t u v w x y z aa"]
    hashes, where = decontam.words(text)
    found = [c for c in finder.candidates(finder.lexicon.places(hashes), np.bincount(where)) if c[1] == 0]
    # the cosine of (5 salt, 27 others) with (12 salt, 1 water)
    assert [c[3] for c in found] == [pytest.approx(5 * 12 / (math.sqrt(25 + 27) * math.sqrt(145)), abs=1e-4)]


def test_cosines_equal_brute_force():
    import numpy as np

    rnd = random.Random(14)
    items = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(5, 40))).encode() for _ in range(6)]
    texts = [" ".join(rnd.choice("abcdefghijXYZ") for _ in range(rnd.randint(1, 120))).encode() for _ in range(20)]
    finder = made(items, texts)
    hashes, where = decontam.words(texts)
    count = np.bincount(where, minlength=len(texts))
    got = {}
    for doc, word, item, cosine in finder.candidates(finder.lexicon.places(hashes), count):
        got[doc, word - sum(count[:doc]), item] = max(cosine, got.get((doc, word - sum(count[:doc]), item), 0))
    expected = {}
    for d, t in enumerate(texts):
        ws = t.decode().lower().split()
        for start in range(0, len(ws), 16):
            window = collections.Counter(ws[start : start + 32])
            for k, item in enumerate(items):
                passage = collections.Counter(item.decode().split())
                dot = sum(window[w] * passage[w] for w in passage)
                length = sum(v * v if w in "abcdefghij" else v for w, v in window.items())  # words that no passage holds count each
                cosine = dot / math.sqrt(length * sum(v * v for v in passage.values()))
                if cosine >= 0.45:
                    expected[d, start, k] = cosine
    assert set(got) == set(expected)
    assert all(got[x] == pytest.approx(expected[x], abs=1e-4) for x in got)


@pytest.mark.parametrize("replaced", [0.1, 0.2, 0.3])
def test_paraphrases_are_found(spark, replaced):
    """Words of the passages replaced at random, the answer's words too: 9 of 10 are found, and nothing else."""
    rnd = random.Random(int(replaced * 100))
    word = lambda: "".join(rnd.choice("bcdfglmnprt") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [f"{prose(n)}. {prose(10)}." for n in [15, 25, 40, 60, 90, 150, 250, 400] * 5]
    docs = []
    for k, t in enumerate(items):
        changed = [word() if rnd.random() < replaced else w for w in t.split()]
        docs.append((k, f"{prose(rnd.randint(0, 90))} {' '.join(changed)} {prose(60)}"))
    docs += [(100 + k, prose(300)) for k in range(20)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got if r.contaminated}
    assert found <= {(k, k) for k in range(len(items))} and len(found) >= 0.9 * len(items)


def test_blocks_of_passages_give_the_same_rows(spark):
    rnd = random.Random(16)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghi") for _ in range(5)) for _ in range(n))
    items = [prose(rnd.randint(5, 60)) for _ in range(20)]
    docs = [(k, f"{prose(40)} {items[k]} {items[(k * 7) % 20]} {prose(30)}") for k in range(20)] + [(None, items[4]), (50, None), (51, ""), (52, prose(90)), (52, items[1])]
    df, bench = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, row int"), spark.createDataFrame([*enumerate(items), (None, items[0])], "item_id long, text string")
    key = lambda r: (r.doc_id or 0, r.n_items, r.item_id or 0, round(r.share or 0, 6), round(r.answer_share or 0, 6))
    one, many = (sorted(map(key, decontam.leaks(df, bench, block_words=n).collect())) for n in (10**6, 150))
    assert one == many and sum(n > 0 for _, n, *_ in one) == 22
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(df, bench, block_words=150).collect()) == sorted((d or 0, t or "") for d, t in docs[-5:] if not t or t not in items)


TEXTS = [
    "mail a.b+c@x-y.example.com, or a@b and q@@r.example.org.", "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 0001.02.3.4", "card 4785380592391139 or 4785-3805 9239-1139 not 4785380592391138",
    "+1 (523) 555-1055. +12 +1 ........ 2 and +49 30 1234567", "", None, "é 😀 a@b.co +44 20 7946 0958 x", "1.1.1.1@1.1.1.1 4111 1111 1111 1111", "@@@@ a@b.c@d.e.f a@b..c 12345678901234567890", "9" * 3000 + "@" + "a." * 500,
]


def brute_spans(text):
    spec = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return sorted(((m.start(), k, m.end()) for k, (p, ok) in enumerate(spec) for m in re.finditer(p, text) if ok(m[0])))


def test_luhn():
    assert pii.luhn("79927398713") and not pii.luhn("79927398710")


def test_base_spans_equal_the_patterns():
    rnd = random.Random(8)
    made = ["".join(rnd.choice(["a", "b@", "@c", ".", "com", "1", "23", " ", "-", "+4", "(5)", "é", "256", "\n", "4785380592391139"]) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    for t in [*filter(None, TEXTS), *made]:
        assert [(s, k, e) for s, e, k in pii.base_spans(t)] == brute_spans(t)


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[1], None)], "doc_id long, text string, spans string")
    got = pii.digest(pii.personal_data(docs)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        spans = brute_spans((TEXTS[1] if r.doc_id is None else TEXTS[r.doc_id]) or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert (r.base_sha256, r.spans, r.n_card) == (hashlib.sha256(joined.encode()).hexdigest(), joined, sum(k == 2 for _, k, _ in spans))
    assert pii.digest(pii.personal_data(docs.limit(0))).count() == 0


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("1" * 1_000_000, "1." * 500_000, "a" * 500_000 + "@", "a@" * 300_000, "x" * 1_000_000, "a" * 500_000 + "@b", "+1" + " " * 500_000, "f" * 1_000_000, "call " + "0" * 5000 + ".1.2.3", "0." * 300_000 + "9" * 300_000):
        spans = pii.base_spans(t)
        pii.secrets(t)
        pii.candidates(t, spans)
        pii.Words(t)
    assert time.time() - began < 30


def test_zeros_before_parts_of_addresses_do_not_count():
    assert [pii.KINDS[k] for _, _, k in pii.base_spans("0" * 5000 + ".1.2.3")] == ["ip"]
    assert pii.base_spans("0000256.1.2.3") == [] and pii.base_spans("0.0.0.0")[0][2] == 1


def test_neighbours_are_whole_words():
    long = "w" * 300
    text = f"{long}1 {' ' * 200}call ({long}) 5550-1234 now"
    s = text.index("5550")
    assert pii.Words(text).around(s, s + 9) == (pii._named(long), "call " + pii._named(long), "now")
    assert pii.Words("a,1.2.3.4").around(2, 9) == ("a", "", "")
    assert pii._named("x" * 65) != pii._named("x" * 64 + "y") and len(pii._named("x" * 500)) == 65


def brute_trusted(rows, rounds=3, support=5, confidence=0.8):
    """Scores by definition: rows of (kind, instance, patterns); kind -1 for candidates."""
    edges = {(k, i, p) for k, i, ps in rows for p in ps}
    instances = collections.Counter(p for p in {(k, i, p) for k, i, p in edges} for p in [p[2]])
    seeds = collections.Counter((p, k) for k, i, p in edges if k >= 0)
    seeds = {x: n for x, n in seeds.items() if n >= support}
    links = {(i, p) for k, i, p in edges if k == -1}
    score, best = {}, {}
    for _ in range(rounds):
        conf = {(p, k): (n + sum(score.get((i, k), 0) for i, q in links if q == p)) / instances[p] for (p, k), n in seeds.items()}
        conf = {x: c for x, c in conf.items() if c >= confidence / 2}
        score, best = {}, {}
        for i, p in links:
            for (q, k), c in conf.items():
                if p == q:
                    score[i, k] = 1 - (1 - score.get((i, k), 0)) * (1 - min(c, 0.999999))
                    best[i, k] = max(best.get((i, k), 0), c)
    found = {}
    for (i, k), s in score.items():
        if best[i, k] >= confidence:
            found[i] = max(found.get(i, (0, 0)), (s, -k))
    return {i: (-k, s) for i, (s, k) in found.items()}


def test_graph_scores_equal_brute_force(spark):
    rnd = random.Random(31)
    rows = []
    for n in range(260):
        kind = rnd.choice([0, 1, 4, -1])
        word = rnd.choice(["mobile", "host", "token"]) if rnd.random() < 0.8 else rnd.choice("abcdefgh")
        rows.append((kind, f"{kind}-{rnd.randint(0, 25)}", word if kind == -1 or rnd.random() < 0.9 else "", "", rnd.choice(["x", "y", ""])))
    df = spark.createDataFrame(rows, "kind int, instance string, before1 string, before2 string, after string")
    for confidence in (0.4, 0.8):
        got = {r.instance: (r.found, r.score) for r in pii.trusted(df, confidence=confidence).collect()}
        expected = brute_trusted([(k, i, [f"{s}:{w}" for s, w in (("1", a), ("2", b), ("3", c)) if w]) for k, i, a, b, c in rows], confidence=confidence)
        assert set(got) == set(expected) and all(got[i][0] == expected[i][0] and got[i][1] == pytest.approx(expected[i][1], abs=1e-6) for i in got)


def test_secrets_are_seeds(spark):
    rows = [(i, f"set token = \"{hashlib.sha256(str(i).encode()).hexdigest()[:40]}\" here") for i in range(20)]
    rows += [(50, 'set token = "k7-short-1" here'), (51, f"a {'ab' * 40} b"), (52, f"a {'12' * 40} b"), (53, "year 1999x here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(docs)).collect()}
    assert got[3].spans == "secret:13:53" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[50].spans == "secret:13:23" and [got[i].spans for i in (51, 52, 53)] == ["", "", ""]
    assert {r.text for r in pii.redact(docs).where("doc_id in (4, 50)").collect()} == {'set token = "[SECRET]" here'}


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"please call mobile: +1 523 555 {1000 + i} today") for i in range(20)] + [(50, "please call mobile: 5550-77-1234 today"), (51, "the page 12345 of it"), (52, "nothing 99999 here")]
    rows += [(60 + i, f"the page {20000 + i} of it") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    added = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(docs)).where("has_added").collect()}
    assert added == {50: "phone:20:32"}
    hidden = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert hidden[50] == "please call mobile: [PHONE] today" and hidden[51] == rows[21][1] and hidden[3] == "please call mobile: [PHONE] today"


def test_texts_are_redacted_where_they_are_read(spark):
    rows = [(i, f"please call mobile: +1 523 555 {1000 + i} today") for i in range(20)] + [(50, "please call mobile: 5550-77-1234 today"), (50, "please call mobile: 5550-77-1234 today"), (None, "1.2.3.4 or a@b.c"), (51, None), (52, "")]
    docs = spark.createDataFrame(rows + [(60 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3).localCheckpoint()
    got = pii.redact(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    joined = pii.redact(docs, sent=0)
    assert joined.schema == got.schema and sorted(map(repr, joined.collect())) == sorted(map(repr, got.collect()))
    assert [r.text for r in got.where("doc_id = 50").collect()] == ["please call mobile: [PHONE] today"] * 2


def test_rounds_end_where_nothing_is_scored(spark, monkeypatch):
    made, cut = [], pii.cut
    monkeypatch.setattr(pii, "cut", lambda df: made.append(1) or cut(df))
    docs = spark.createDataFrame([(i, f"w{i} +1 523 555 {1000 + i} at {20000 + i} x") for i in range(20)], "doc_id long, text string")
    assert pii.trusted(pii.occurrences(docs), rounds=3).count() == 0 and len(made) == 4
    made.clear()
    docs = spark.createDataFrame([(i, f"please call mobile: +1 523 555 {1000 + i} today") for i in range(20)] + [(50, "please call mobile: 5550-77-1234 today")], "doc_id long, text string")
    assert pii.trusted(pii.occurrences(docs), rounds=3).count() == 1 and len(made) == 6
