"""Decontamination, quality rules, licences, URLs and toxicity on small tables."""

import random
import zlib

import numpy as np
import pytest
from brute import documents

from grouptrace.llm import decontamination, license_scan, quality_rules, toxicity, url_filter
from grouptrace.llm.license_texts import NOTICES, TEXTS


def items(spark, pairs):
    return spark.createDataFrame(pairs, "item_id long, text string")


def leaked(spark, texts, pairs, extra=None):
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(documents(spark, texts, extra), items(spark, pairs)).collect()}


QUESTION = "On Monday the farmer Anna had 12 apples and 30 km later she gave 12 apples to her neighbour Bert near the old mill."


def test_verbatim_and_new_parameters_are_found(spark):
    other = QUESTION.replace("Anna", "Maria").replace("12", "75").replace("30 km", "9 miles").replace("Bert", "Paul")
    unlike = QUESTION.replace("had 12", "had 75").replace("gave 12", "gave 80")
    texts = [(1, QUESTION), (2, "Before. " + other + " After."), (3, unlike), (4, "nothing of it " * 20), (5, None), (6, ""),
             (7, QUESTION.replace(" ", "\n  ").replace(",", ";"))]
    clashes = {"key": "k", "slots": 1, "place": 2, "item_id": 3}
    assert leaked(spark, texts, [(1, QUESTION), (2, None), (3, "")], clashes) == {(1, 1), (2, 1), (7, 1)}


def test_short_items_are_searched_whole(spark):
    assert leaked(spark, [(1, "so what is the capital of northern utopia then"), (2, "what is the capital")],
                  [(9, "What is the capital of northern Utopia?")]) == set()
    assert leaked(spark, [(1, "He asked: what is the capital of northern utopia?"), (2, "what is the capital")],
                  [(9, "what is the capital of northern utopia")]) == {(1, 9)}


def test_templates_of_slots_alone_match_nothing(spark):
    numbers = " ".join(str(i) for i in range(40))
    assert leaked(spark, [(1, numbers)], [(1, " ".join(str(7 * i) for i in range(40)))]) == set()


def test_random_passages(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(200)}x"
    bench = [(i, " ".join(word() for _ in range(r.randrange(10, 60)))) for i in range(15)]
    texts = []
    for d in range(60):
        w = [word() for _ in range(r.randrange(0, 80))]
        if r.random() < 0.5:
            own = r.choice(bench)[1].split()
            a = r.randrange(len(own))
            w[len(w) // 2:len(w) // 2] = own[a:a + r.randrange(5, 30)]
        texts.append((d, " ".join(w)))
    grams = {}
    for i, t in bench:
        w = t.split()
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k:k + 10]), set()).add(i)
    want = {(d, i) for d, t in texts for k in range(len(t.split()) - 9) for i in grams.get(tuple(t.split()[k:k + 10]), ())}
    assert leaked(spark, texts + texts[:3], bench) == want and want


def test_verbatim_copies_are_found_whatever_they_hold(spark):
    sums = " ".join(f"{i} + {3 * i} = {4 * i}" for i in range(10, 22))
    title = "The Old Mill Near Silver Creek Was Bought By Anna Berg And Paul Stone In Spring"
    german = "Am Montag kaufte der Bauer zwei Pferde auf dem Markt von Neustadt und gab dem Nachbarn sein Geld"
    short, tiny = "What is the boiling point of mercury", "Name four Moons"
    pairs = [(1, sums), (2, title), (3, german), (4, short), (5, tiny)]
    texts = [(1, "see " + sums), (2, title.upper()), (3, german.lower()), (4, "Q1 " + short + "? 357"), (5, "please: " + tiny + "."),
             (6, " ".join(str(7 * i) for i in range(40))), (7, "Name four moons or Moons four Name")]
    assert leaked(spark, texts, pairs) == {(i, i) for i in range(1, 6)}


def test_passages_and_rows_are_judged_alone(spark):
    one, two = QUESTION.replace("12", "75"), QUESTION.replace("12", "80")
    filler = lambda letter: " ".join(f"{letter}{i}x" for i in range(30))
    pair = QUESTION + " " + filler("a") + " " + QUESTION
    texts = [(1, one), (1, two), (2, one + " " + filler("b") + " " + two), (3, one.replace("gave 75", "gave 80"))]
    assert leaked(spark, texts, [(1, QUESTION)]) == {(1, 1), (2, 1)}
    assert leaked(spark, texts[2:], [(1, pair)]) == {(2, 1)}
    long = " ".join(f"c{i}x" for i in range(100))
    found = decontamination.leaks(documents(spark, [(1, "12 apples " + long + " 13 apples")]), items(spark, [(1, "12 apples " + long + " 12 apples")]))
    # All windows but the two that hold the altered number, whether or not the rest of its run agrees.
    assert [(r.n_windows, r.first_token, r.n_tokens) for r in found.collect()] == [(93, 0, 102)]


def test_empty_tables_have_no_leaks(spark):
    assert leaked(spark, [], [(1, QUESTION)]) == set()
    assert leaked(spark, [(1, QUESTION)], []) == set()
    assert leaked(spark, [(None, QUESTION)], [(1, QUESTION)]) == set()


def measures(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines),
            len(lines) - len(set(lines)), len(covered))


def test_measures_agree_with_plain_python(spark):
    r = random.Random(8)
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "a b c d e " * 4), (4, "x " * 30), (5, "ü\x0bö\x0c|é\r#\x1cz"), (6, "one two three four five")]
    texts += [(d, "".join(r.choice(["a ", "b ", "c", " ", "\n", "* ", "the ", "a b\n"]) for _ in range(r.randrange(120)))) for d in range(10, 60)]
    texts += [(100, " ".join(f"w{i % 900}" for i in range(4000)))]
    rows = quality_rules.judged(documents(spark, texts, {"n_words": "x", "_words": 1, "kept": 2})).collect()
    got = {r.doc_id: tuple(r)[1:7] for r in rows}
    for d, t in texts:
        n, chars, symbols, lines, twice, again = measures(t)
        assert got[d] == (n, chars, symbols, lines, twice, again), d
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert quality_rules.judged(documents(spark, [])).collect() == []


def test_rules_name_what_failed(spark):
    clean = "the cat sat on a mat and it was in the house with some of its old friends"
    texts = [(1, clean), (2, clean.replace(" ", "| ")), (3, "qqq www eee rrr ttt yyy uuu iii ooo ppp aaa"), (4, (clean + "\n") * 1 + "x\nx\nx\nx")]
    got = {r.doc_id: (r.kept, r.failed_rules) for r in quality_rules.judged(documents(spark, texts)).collect()}
    assert got[1] == (True, [])
    assert "symbols" in got[2][1] and got[3][1] == ["stop_words"] and "repeated_lines" in got[4][1]


def test_licences_by_digest(spark):
    mit = dict(TEXTS[1:2])["MIT"]
    texts = [(1, "Copyright (c) 2019 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(",", " ;")),
             (2, mit + " and more"), (3, "prose\n  licensed under the APACHE Licence, version 2 \nmore"), (4, None), (5, ""),
             (6, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nReleased under the MIT Licence"),
             (7, "see: Released under the MIT License, mostly")]
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scanned(documents(spark, texts, {"license": "l", "notices": 1})).collect()}
    assert got == {1: ("MIT", []), 2: (None, []), 3: (None, ["Apache-2.0"]), 4: (None, []), 5: (None, []),
                   6: (None, ["CC-BY-NC-4.0", "MIT"]), 7: (None, [])}
    assert license_scan.scanned(documents(spark, [])).collect() == []


def test_every_known_text_finds_itself(spark):
    known = [*TEXTS, *NOTICES]
    rows = license_scan.scanned(documents(spark, [(i, t) for i, (_, t) in enumerate(known)])).collect()
    assert {r.doc_id: r.license for r in rows} == {i: name for i, (name, _) in enumerate(known)}
    assert all("licen" in t.lower() for _, t in NOTICES)
    assert all(r.canonical_sha256 == license_scan.digest(known[r.doc_id][1]) for r in rows)


URLS = [
    "http://a.net/x", "http://net/", "http://example.net/en/5", "http://sub.EXAMPLE.net/en/?q", "http://example.net/en",
    "http://example.net", "http://notexample.com/de/1", "http://www.example.com/de/1", "http://example.com/fr/", "x", None, "",
    "http://b.org/fr/z#f", "http://b.org/fr", "ftp://casino-win.org/en/", "a\n://b.net/c", "http://x.y://z.net/q", "http:///net/",
]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rules, verdict in ((url_filter.BLOCK_RULES, "block"), (url_filter.ALLOW_RULES, "allow")):
        for rule in rules:
            domain, start = rule.split("/", 1)
            if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
                fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if set(host.split(".")) & set(url_filter.LISTED_NAMES) else "allow"


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, key string, host long")
    rows = url_filter.judged(pages, url_filter.BLOCK_RULES, url_filter.ALLOW_RULES, url_filter.LISTED_NAMES).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r["row"]["url"]), r["row"]["url"]
    assert url_filter.judged(pages.limit(0), ("net/",), ()).collect() == []


def test_a_cascade_is_exact_for_its_universe(spark):
    universe = spark.range(20000).selectExpr("concat('k', id) AS key")
    listed = [f"k{i}" for i in range(0, 20000, 3)] + ["elsewhere"]
    found = url_filter.cascade(universe, listed)
    import pyarrow as pa

    keys = [f"k{i}" for i in range(20000)]
    assert np.array_equal(found.listed(url_filter._hashes(pa.array(keys))), np.isin(keys, listed))
    assert len(found.levels) > 2
    assert not url_filter.cascade(universe, []).listed(url_filter._hashes(pa.array(keys))).any()


def test_tables_of_many_keys_equal_a_plain_join(spark):
    pages = spark.range(2000).selectExpr(
        "id AS page_id", "concat('http://n', id % 700, '.d', id * 7 % 900, '.net/p', id % 11, '/q', id % 7, '/x') AS url")
    names = spark.range(0, 60000, 3).selectExpr("concat('n', id) AS name").union(spark.createDataFrame([(None,)], "name string"))
    rules = spark.range(30000).selectExpr(
        "concat('d', id % 5000, '.net/', if(id % 3 = 0, '', concat('p', id % 11, '/'))) AS rule", "if(id % 5000 % 4 = 0, 'block', 'allow') AS verdict"
    ).where("substr(rule, 2, 1) <> '1'").distinct()
    block, allow = (rules.where(f"verdict = '{v}'").select("rule") for v in ("block", "allow"))
    got = url_filter.judged(pages, block, allow, names).select("row.page_id", "rule", "verdict").collect()
    pages.createOrReplaceTempView("p"), rules.createOrReplaceTempView("r"), names.createOrReplaceTempView("n")
    want = spark.sql("""
        WITH parts AS (SELECT page_id, split(url, '/')[2] AS host, concat('/', split(url, '/', 4)[3]) AS path FROM p),
        cut AS (SELECT *, substring_index(rule, '/', 1) AS domain, substr(rule, instr(rule, '/')) AS start FROM r),
        fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM parts
          JOIN cut ON domain = substr(host, instr(host, '.') + 1) AND startswith(path, start) GROUP BY page_id),
        bad AS (SELECT DISTINCT page_id FROM parts JOIN n ON name = substring_index(host, '.', 1))
        SELECT page_id, rule, coalesce(verdict, if(bad.page_id IS NULL, 'allow', 'block')) AS verdict
        FROM parts LEFT JOIN fits USING (page_id) LEFT JOIN bad USING (page_id)""").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    kinds = {(r.rule is None, r.verdict) for r in want}
    assert len(kinds) == 4 and names.count() > 20000 and rules.count() > 5000
    with pytest.raises(ValueError):
        url_filter.judged(pages, spark.createDataFrame([("net",)], "rule string"), allow)


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    r = random.Random(2)
    plain = ["".join(r.choice(["ba", "de", "ki", "lo", "mu", "na"]) for _ in range(3)) for _ in range(300)]
    bad = ["grizzlefop", "snarkwump", "blathergit"]
    rows, labels = [], []
    for d in range(900):
        w = [r.choice(plain) for _ in range(r.randrange(20, 120))]
        y = int(r.random() < 0.3)
        if y:
            for _ in range(1 + len(w) // 15):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((d, " ".join(w)))
        labels.append((d, 1, y))
    rows += [(2000, None), (2001, ""), (2002, rows[0][1] + " grizzlefopp snarkwumpe blathergitt grizlefop " * 3), (2003, "%% || 1")]
    rows += [(2004, " ".join(r.choice(plain) for _ in range(20000)))]
    labels += [(2000, 1, 1), (2001, 1, 0), (5, None, None), (None, 1, 1), (6, 1, labels[6][2])]
    return documents(spark, rows, {"score": "s", "row": 1, "toxic": 2}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(
        (d, y) for d, _, y in labels[:900])


def test_held_out_accuracy_and_misspellings(toxic_corpus):
    docs, labels, truth = toxic_corpus
    rows = {r["row"]["doc_id"]: r for r in toxicity.classified(docs, labels).collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in rows)
    assert np.mean([rows[d].predicted == truth[d] for d in held]) > 0.9
    assert rows[2002].score > rows[0].score if not truth[0] else True
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert rows[2000].score == rows[2001].score == rows[2003].score or rows[2000].score == rows[2001].score
    assert rows[2004].predicted == 0


def test_without_labels_or_rows(spark, toxic_corpus):
    docs, labels, _ = toxic_corpus
    none = labels.limit(0)
    assert {r.score for r in toxicity.classified(docs, none).collect()} == {0.5}
    assert toxicity.classified(docs.limit(0), labels).collect() == []


def test_scores_don_t_depend_on_neighbours():
    model = toxicity.train(["bad worm " * 5, "good bird " * 5] * 10, [1, 0] * 10, epochs=2)
    from grouptrace.llm import words
    import pyarrow as pa

    texts = ["bad worm", None, "good bird", "bad", "", "worm worm worm", "x"]
    alone = [model.scores(d, b)[0] for t in texts for _, d, b in words.chunks(pa.array([t], pa.string()))]
    together = np.concatenate([model.scores(d, b) for _, d, b in words.chunks(pa.array(texts, pa.string()))])
    assert np.allclose(alone, together)
