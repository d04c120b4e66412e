"""Long texts, hot keys and independent versions of what the operators learn."""

import base64
import json
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import op03_language as language
from quadrille.llm import op04_quality_classifier as quality
from quadrille.llm import op07_secrets as secrets
from quadrille.llm.op02_token_counts import Counter as Pieces
from quadrille.llm.op02_token_counts import MARK, VOCABULARY, Vocabulary, count_tokens
from quadrille.llm.op05_mix import mixed
from quadrille.llm.op06_warc import drop_archives, read_records, write_archives


def spans_of(text):
    return next(secrets.scan_batch(pa.array([text]), secrets.automaton()))


@pytest.mark.parametrize(
    "text",
    ["deadbeef" * 5 + " ", "eyJ", "eyJhIjoxfQ.", "token = short ", "-----BEGIN PRIVATE KEY-----MAAA", "AKIA", "é" + "0" * 32 + "g", "token" + " " * 40],
    ids=["hashes", "jwt starts", "jwt parts", "assign", "pem", "access", "hex", "blanks"],
)
def test_secrets_in_linear_time(text):
    times = []
    for size in (1 << 20, 5 << 20):
        whole = text * (size // len(text.encode()))
        began = time.perf_counter()
        spans_of(whole)
        times.append(time.perf_counter() - began)
    assert times[1] < 20 and times[1] < 15 * max(times[0], 0.05)


def test_secret_checksums():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    der = lambda n: base64.encodebytes(bytes([0x30, 0x82]) + n.to_bytes(2, "big") + bytes(range(256)) * 2).decode()
    pem = lambda b, kind="RSA ": f"-----BEGIN {kind}PRIVATE KEY-----\n{b}-----END {kind}PRIVATE KEY-----"
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    deep = "eyJ" + base64.urlsafe_b64encode(b'a":' + b"[" * 300000).decode().rstrip("=")
    cases = {
        f"é npm_{body}{secrets.checksum62(body)}!": [(2, 42, "npm")],
        f"npm_{body}000000": [],
        f"npm_{body}{secrets.checksum62(body)}x": [],
        pem(der(512)): [(0, len(pem(der(512))), "pem")],
        pem(der(512), ""): [(0, len(pem(der(512), "")), "pem")],
        pem(der(511)): [],
        pem("not base64!"): [],
        f"{part({'a': 1})}.{part({'b': 2})}.sig-_": [(0, len(part({"a": 1})) + len(part({"b": 2})) + 7, "jwt")],
        f"{part({'a': 1})}.eyJnot.sig": [],
        f"x{part({'a': 1})}.{part({'b': 2})}.sig": [],
        f"{deep}.{deep}.x": [],
    }
    for text, want in cases.items():
        assert spans_of(text) == want, text[:60]


def test_secrets_repeated_and_null_ids(spark):
    rows = [(1, "token=abcdefgh12"), (1, "token=abcdefgh12"), (1, "none"), (None, "token=abcdefgh12"), (None, None)]
    got = secrets.find_secrets(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, spans string")).collect()
    assert Counter((r.doc_id, r.n_assign) for r in got) == Counter({(1, 1): 2, (1, 0): 1, (None, 1): 1, (None, 0): 1})


def test_warc_large_pages(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i % 3}" * (1 << 20) if i < 6 else f"<b>{i}") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(1)
    index = write_archives(df)
    sizes = read_records(index).select("page_id", F.octet_length("payload").alias("n"), "payload_bytes", "refers_to").collect()
    assert len(sizes) == 300
    for r in sizes:
        assert r.payload_bytes == len(pages[r.page_id][2]) and r.refers_to == (r.page_id + 3 if r.page_id < 3 else None) and r.n == (0 if r.page_id < 3 else r.payload_bytes)
    drop_archives(spark, index)


def test_mix_of_rows_alike(spark):
    rows = [(None, "a b c", "s")] * 3000 + [(7, "a b c", "s")] * 500 + [(i, "a " * (1 + i % 5), "t") for i in range(400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, size int")
    got = [tuple(r) for r in mixed(df, fan_in=16).collect()]
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(str(tuple(r)) for r in mixed(df.repartition(5), fan_in=16).collect())
    taken, target = defaultdict(int), {}
    for _, size, source_size, t, k, copies in got:
        assert k == copies * size and copies <= 3
        taken[source_size] += k
        target[source_size] = t
    assert all(abs(taken[s] - t) <= 5 for s, t in target.items())


def best_segmentation(text, pieces, unknown, fallback):
    """Score and count over all segmentations; of equal scores the one whose last piece starts first, place by place."""
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(end):
            piece = text[start:end]
            if piece in pieces:
                offer = best[start][0] + pieces[piece], best[start][1] + 1
            elif end - start == 1:
                offer = best[start][0] + unknown, best[start][1] + (len(piece.encode()) if fallback else 1)
            else:
                continue
            if found is None or offer[0] > found[0]:
                found = offer
        best.append(found)
    return best[-1]


@pytest.mark.parametrize("whole", [True, False])
def test_viterbi_against_all_segmentations(whole):
    r = random.Random(3)
    letters = "ab" + MARK + "é"
    for _ in range(60):
        names = {"".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(12)} | {"a"}
        names = {n for n in names if not whole or MARK not in n.lstrip(MARK)}
        pieces = {n: float(-r.randint(1, 4)) if whole else -r.random() for n in names}
        v = Vocabulary(tuple(pieces.items()), r.random() < 0.5, True)
        assert v.apart == whole or not whole
        counter = Pieces(v)
        for _ in range(20):
            text = "".join(r.choice("ab é🎉") for _ in range(r.randint(1, 14)))
            score, n = counter.count(text)
            want = best_segmentation(MARK + text.replace(" ", MARK), pieces, v.least - 10.0, v.bytes_for_unknown)
            assert n == want[1] and score == pytest.approx(want[0])


def test_token_counts_of_real_vocabulary(spark):
    v = Vocabulary.load(VOCABULARY)
    pieces = dict(v.pieces)
    texts = ["the quick brown fox", "  two  blanks ", "naïve 🎉 straße", "x" * 300, "a\nb\tc", "", None]
    got = {r.doc_id: r for r in count_tokens(spark.createDataFrame([(*r, 1) for r in enumerate(texts)], "doc_id bigint, text string, n_tokens int")).collect()}
    for i, t in enumerate(texts):
        want = best_segmentation(MARK + t.replace(" ", MARK), pieces, v.least - 10.0, v.bytes_for_unknown) if t else (0.0, 0)
        assert (got[i].score, got[i].n_tokens) == want


def plain_trigrams(text):
    low = "".join(c if c.isalpha() else " " for c in f" {text} ")
    low = "".join(x if len(x := c.lower()) == 1 else c for c in low)
    low = re.sub(" +", " ", low)
    return [low[i : i + 3] for i in range(len(low) - 2) if low[i + 1] != " "]


def test_language_against_plain_sets(spark):
    r = random.Random(9)
    bank = {"da": "og det er en ikke på med for som", "fi": "ja se on ei että oli mutta kun hän", "zz": "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ 𰀀𰀁𰀂 𰀃𰀄"}
    rows = [(i, " ".join(r.choice(bank[lang].split()) for _ in range(r.randint(1, 60))) + r.choice(["", " 12", "!"]), lang) for i, lang in enumerate(r.choice(sorted(bank)) for _ in range(200))]
    rows += [(300, "𰀀" * 20, None), (301, None, "da"), (302, "12 34", "fi"), (303, "İstanbul ǅ", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    train = [x for x in rows if x[2] and x[1] and not quality_fold(x[0], 3) == 1]
    counts = defaultdict(Counter)
    for _, t, lang in train:
        counts[lang].update(plain_trigrams(t))
    kept = {lang: {g for g, n in c.items() if n >= 1e-4 * sum(c.values())} for lang, c in counts.items()}
    for r_ in language.identify_languages(df).collect():
        t = next(x[1] for x in rows if x[0] == r_.doc_id)
        grams = plain_trigrams(t or "")
        hits = {lang: sum(g in kept[lang] for g in grams) for lang in sorted(kept)}
        want = max(hits, key=hits.get) if grams else "und"
        assert r_.lang_pred == want or sorted(hits.values())[-2] >= hits[want] - 1, (t, hits, r_)
        assert r_.held_out == (quality_fold(r_.doc_id, 3) == 1)


def quality_fold(i, n):
    import zlib

    return zlib.crc32(str(i).encode()) % n


def test_language_ties(spark):
    rows = [(i, "abc abc", lang) for i, lang in enumerate(["x", "y"] * 20)]
    got = language.identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert {r.lang_pred for r in got.collect()} == {"x"}


def test_ridge_and_isotonic_against_plain_versions(spark):
    rng = np.random.default_rng(5)
    p = len(quality.FEATURES)
    x = rng.normal(size=(400, p))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(int)
    fold = np.arange(400) % 4
    rows = spark.createDataFrame([(a.tolist(), int(b), int(c)) for a, b, c in zip(x, y, fold)], "features array<double>, label int, fold int").repartition(7)
    model = quality.learn_quality(rows, F.col("fold") < 3, F.col("fold") == 3)
    fit = fold < 3
    mean, scale = x[fit].mean(axis=0), np.maximum(x[fit].std(axis=0), 0.01)
    z = quality.fourier((x - mean) / scale)
    n, width = fit.sum(), z.shape[1]
    # Ridge as least squares with the penalty's rows appended.
    direct = np.linalg.lstsq(np.concatenate([z[fit], np.sqrt(quality.RIDGE * n / width) * np.eye(width)]), np.concatenate([y[fit], np.zeros(width)]), rcond=None)[0]
    assert model.weights == pytest.approx(direct, abs=1e-8)
    raw = z[~fit] @ direct
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(at)
    rate, k = (y[fit].sum() + 1) / (n + 2), len(bins)
    count = np.array([(at == b).sum() for b in bins]) + quality.PRIOR / k
    total = np.array([y[~fit][at == b].sum() for b in bins]) + quality.PRIOR * rate / k
    # Isotonic regression as the greatest of the least means.
    level = [max(min(total[i:j].sum() / count[i:j].sum() for j in range(m + 1, k + 1)) for i in range(m + 1)) for m in range(k)]
    assert model.levels == pytest.approx(np.array(level))


def test_quality_labels_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "fine plain words here " * 20 if i % 2 else "$$$ ### " * 30, 1, 0.5) for i in range(200)], "doc_id bigint, text string, label int, score double")
    labels = spark.createDataFrame([(i, i % 2, "t", 1.0) for i in range(200)] + [(i, 7, "t", 1.0) for i in range(200)], "doc_id bigint, quality int, text string, features double")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 200 and all(r.predicted == r.doc_id % 2 for r in got)


def shingle_set(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_components(rows, k=4):
    """Smallest id of each row's component over all pairs of rows, by (id, set)."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and rows[a][0] is not None and rows[b][0] is not None and 100 * n >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return [None if d is None else least[find(i)] if sets[i] else d for i, (d, _) in enumerate(rows)]


def test_near_duplicates_of_repeated_ids_and_large_groups(spark, monkeypatch):
    """One id with different texts, a large group of near copies, chains, and ties, against all pairs."""
    from quadrille.llm import op10_near_dup as op

    monkeypatch.setattr(op, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(op, "STAR_ROWS", 16)
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.randint(0, 5)):
            t[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(t)))
    chain = [f"c{i}" for i in range(80)]
    for i in range(30):
        rows.append((200 + i, " ".join(chain[i : i + 50])))
    rows += [(1, " ".join(chain[40:])), (1, " ".join(f"z{i}" for i in range(30))), (300, " ".join(f"z{i}" for i in range(31))), (None, rows[0][1]), (None, None), (301, ""), (301, "one two"), (302, "One  TWO"), (5, rows[9][1]), (5, rows[9][1])]
    df = spark.createDataFrame([(*x, 1, [2]) for x in rows], "doc_id bigint, text string, n_shingles int, c1 array<int>").repartition(3)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in op.near_duplicates(df).collect())
    assert got == Counter((d, len(shingle_set(t)), c) for (d, t), c in zip(rows, plain_components(rows)))


def plain_contaminated(rows, items):
    """Best similarity of all windows of each text to each item."""
    out = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        for i, t in items:
            iw = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            n = min(5, len(iw))
            if not iw or len(w) < n:
                continue
            bag = lambda x, n=n: Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))
            b = bag(iw)
            best = max(sum((a & b).values()) / sum((a | b).values()) for a in (bag(w[s : s + len(iw)]) for s in range(max(1, len(w) - len(iw) + 1))))
            if best >= 0.8:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_contaminated_recall_near_the_threshold(spark):
    """Passages edited to just above 0.8, ties of equal windows, one word repeated, long texts, short items, clashing columns."""
    from quadrille.llm.op08_decontaminate import contaminated

    r = random.Random(31)
    words = [f"v{i}" for i in range(900)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([40, 60, 60, 90])))) for i in range(25)] + [(90, "word " * 30), (91, "alpha beta"), (92, None), (93, "solo")]
    rows = []
    for d in range(150):
        w = items[r.randrange(25)][1].split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "edited"
        if d % 3 == 0:
            k = r.randrange(len(w))
            w = w[k:] + w[:k]
        filler = lambda: [r.choice(words) + "f" for _ in range(r.randint(0, 60))]
        rows.append((d, " ".join(filler() + w + filler() + (w if d % 10 == 0 else []))))
    rows += [(500, "word " * 400), (501, "x Alpha BETA y solo"), (502, " ".join(filler() * 300) + " " + items[0][1] + " tail" * 3000)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, item_id int, len int").repartition(3)
    bench = spark.createDataFrame([(*x, 1, "h") for x in items], "item_id bigint, text string, doc_id int, hashes string")
    want = plain_contaminated([x for x in rows if x[0] != 502], items)
    want[502, 0] = 1.0
    got = {(x.doc_id, x.item_id): x.similarity for x in contaminated(docs, bench).collect()}
    assert got == pytest.approx(want) and sum(v < 0.86 for v in want.values()) > 10 and (501, 91) in got and (500, 90) in got


def plain_mcd(x):
    """Regularised minimum covariance determinant by whole-data concentration steps: mean, covariance."""
    from quadrille.llm import op01_quality_rules as rules

    floor, best = np.diag(rules.FLOOR**2), None
    h = max(1, round(rules.SHARE * len(x)))
    middle = np.median(x, axis=0)
    scale = np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, rules.FLOOR)
    squashed = np.cov(np.tanh((x - middle) / scale).T, bias=True) * np.outer(scale, scale) + floor
    for mean, cov in ((middle, np.diag(scale**2)), (middle, squashed), (x.mean(axis=0), np.cov(x.T, bias=True) + floor)):
        for _ in range(30):
            y = x - mean
            near = x[np.argsort((y * np.linalg.solve(cov, y.T).T).sum(axis=1))[:h]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * rules.CONSISTENCY + floor
        size = np.linalg.slogdet(cov)[1]
        if best is None or size < best[0]:
            best = size, mean, cov
    return best[1:]


@pytest.mark.parametrize("limit", [4096, 3])
def test_quality_verdicts_against_plain_mcd(spark, limit):
    from quadrille.llm import op01_quality_rules as rules
    from quadrille.llm.textstats import statistics

    r = random.Random(21)
    bank = {"en": ["stone", "river", "over", "the", "house", "of", "light"], "de": ["straße", "und", "über", "haus", "der"], None: ["a", "bc", "def"]}
    rows = []
    for i in range(900):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", None])
        words = [r.choice(bank[lang]) + r.choice(["", "s", "ing", "."]) + r.choice(["", str(r.randint(0, 999))]) for _ in range(r.randint(55, 400))]
        if i % 25 == 0:
            words = [w.upper() + r.choice(["%$#", "!!|", "**"]) for w in words]
        rows.append((i, " ".join(words) + "\n" * (i % 3), lang, source))
    rows += [(i, "too short", "xx", "only") for i in range(900, 905)] + [(905, None, None, None), (3, rows[3][1], rows[3][2], rows[3][3])]
    df = spark.createDataFrame([(*x, 1.0, "g") for x in rows], "doc_id bigint, text string, lang string, source string, distance double, grp string").repartition(4)
    got = {x.doc_id: x for x in rules.quality_rules(df, model_limit=limit).collect()}
    assert len(got) == 906 and all(got[i].distance is None and not got[i].kept for i in range(900, 905))
    feats = {x.doc_id: np.array(x.features) for x in statistics(df, "doc_id", "text").collect()}
    good = [x for x in rows if not got[x[0]].base_failed]
    of = lambda keep: plain_mcd(np.array([feats[x[0]] for x in good if keep(x)]))
    whole, held, wide, count = of(lambda x: True), {}, {}, Counter((x[2], x[3]) for x in good)
    mixed_in = lambda n, own, other: tuple((n * a + rules.PRIOR_ROWS * b) / (n + rules.PRIOR_ROWS) for a, b in zip(own, other))
    for lang, source in count:
        if lang not in wide:
            wide[lang] = mixed_in(sum(n for k, n in count.items() if k[0] == lang), of(lambda x: x[2] == lang), whole)
        held[lang, source] = mixed_in(count[lang, source], of(lambda x: (x[2], x[3]) == (lang, source)), wide[lang])
    errors = []
    for i, _, lang, source in good:
        mean, cov = held[lang, source]
        y = feats[i] - mean
        d = y @ np.linalg.solve(cov, y)
        errors.append(abs(got[i].distance - d) / (1 + d))
        assert got[i].kept == (d < rules.CUTOFF) or abs(d / rules.CUTOFF - 1) < 0.1
    assert np.median(errors) < 0.05 and max(errors) < 0.3
    assert not any(got[i].kept for i in range(0, 900, 25)) and sum(got[i].kept for i in range(900)) >= 860
    assert rules.chi_square(rules.chi_square_quantile(0.99, 12), 12) == pytest.approx(0.99) and rules.chi_square_quantile(0.95, 2) == pytest.approx(5.991464547)
