"""Operators that judge texts one by one: quality counts, secrets, BPE, token counts, licences, HTML."""

import hashlib
import json
import math
import random
import re
import time

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from quantide.llm import bpe, html_text, licenses, quality, secrets, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in is on at by for with that this from as it be or an".split()


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def mixed_texts(n=120, seed=5):
    rnd = random.Random(seed)
    parts = ["a", "b", "the", " ", "\n", "  ", "é", "日本", "1", "23", "!", "<|endoftext|>", "'s", "ing", "xyz", " ", "𐍈", "aaaa", "-----", "▁", "\t"]
    return ["", " ", "x"] + ["".join(rnd.choices(parts, k=rnd.randint(0, 120))) for _ in range(n)]


# -- quality ------------------------------------------------------------------------


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {w for w in wins if wins.count(w) > 1}
    covered = {i + k for i, w in enumerate(wins) if w in again for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a b a b a b", "x\ny\nx\n\n", "a b c", "# $ 日本 | é"] + [" ".join(rnd.choices(WORDS[:4], k=rnd.randint(1, 60))).replace("of to", "of\nto") for _ in range(60)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs(spark, texts)).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_quality_keeps_clean_drops_junk(spark):
    rnd = random.Random(3)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(n))
    clean = [prose(rnd.randint(60, 300)) for _ in range(60)]
    junk = [" ".join(w + "###" for w in prose(80).split()) for _ in range(6)]
    frame = docs(spark, clean + junk + ["too short", None])
    kept = {r.doc_id for r in quality.keep_good(frame).collect()}
    assert kept == set(range(60))
    assert quality.keep_good(frame).columns == frame.columns
    # null groups, extra columns with clashing names, repeated rows
    odd = frame.selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "n_chars", "text as h", "1 as rate", "2 as bin", "3 as _q_text", "4 as n_words", "5 as _salt", "6 as _r_lang", "7 as _quality_kept", "8 as _lim_symbol_rate_high", "9 as node", "10 as n2", "11 as n", "12 as cdf")
    assert quality.with_counts(odd).select("_q_text").distinct().count() == 1 and quality.keep_good(odd).columns == odd.columns
    assert {r.doc_id for r in quality.keep_good(odd.union(odd)).collect()} == set(range(60))
    assert quality.judge(frame.limit(0)).count() == 0


def judged(spark, rows):
    counted = spark.createDataFrame(rows, "doc_id int, lang string, source string, n_symbols long, word_chars long").selectExpr("*", "1000L n_words", "0L n_dup_lines", "10L n_lines", "0L n_repeat_words")
    rules = quality.QualityRules()
    limits = quality.merged_limits(quality.sketches(counted, rules), rules)
    return {r.source: r for r in limits.collect()}, {r.doc_id for r in quality.verdicts(counted, limits, rules).where("not kept").collect()}


@pytest.mark.parametrize("share", [20, 26, 50, 70, 90])
def test_common_junk_sets_no_limit(spark, share):
    """A dirty source's junk goes whatever its share; a source that is a little denser than its language stays."""
    rows = [(i, "en", "dirty", 488 if i < share else 0, 5000) for i in range(100)]
    rows += [(100 + i, "en", "clean", i % 41, 5000) for i in range(200)] + [(300 + i, "en", "dense", 60 + i, 5000) for i in range(40)]
    _, gone = judged(spark, rows)
    assert gone == set(range(share))


def test_limits_follow_each_source_and_language(spark):
    """Sources of different spread get different limits, and what is junk in one is usual in another."""
    rows = [(i, "en", "plain", i % 5, 5000) for i in range(100)] + [(100 + i, "en", "tables", 5 * (i % 9), 5000 + 20 * (i % 9)) for i in range(100)]
    rows += [(200 + i, "de", "plain-de", 100 + i % 50, 7000 + i) for i in range(100)] + [(300, "en", "plain", 30, 5000), (301, "en", "tables", 30, 5000), (302, "de", "plain-de", 30, 5000), (303, "en", "few", 20, 5000)]
    limits, gone = judged(spark, rows)
    assert limits["plain"].symbol_rate_high < limits["tables"].symbol_rate_high < limits["plain-de"].symbol_rate_high
    assert limits["tables"].word_length_low < limits["plain"].word_length_low and limits["few"].symbol_rate_high > limits["plain"].symbol_rate_high
    # 302 has words too short for its language only
    assert gone == {300, 302}


def test_short_texts_are_given_noise(spark):
    """The same rate counts against a long text and not against a short one."""
    rows = [(i, "en", "s", 0, 0, 1000, 100) for i in range(200)] + [(200, "en", "s", 2, 0, 50, 10), (201, "en", "s", 40, 0, 1000, 100), (202, "en", "s", 0, 2, 1000, 20), (203, "en", "s", 0, 9, 1000, 90)]
    counted = spark.createDataFrame(rows, "doc_id int, lang string, source string, n_symbols long, n_dup_lines long, n_words long, n_lines long").selectExpr("*", "5 * n_words word_chars", "0L n_repeat_words")
    rules = quality.QualityRules()
    out = quality.verdicts(counted, quality.merged_limits(quality.sketches(counted, rules), rules), rules)
    assert {r.doc_id for r in out.where("not kept").collect()} == {201, 203}


def test_quality_is_native(spark):
    plan = quality.keep_good(docs(spark, ["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sketches_merge(spark):
    """The histogram of a union is the sum of the parts' histograms."""
    rules = quality.QualityRules(min_words=1)
    a, b = (quality.with_counts(docs(spark, [" ".join(WORDS[:k]) + "#" * k for k in r])) for r in (range(3, 15), range(8, 19)))
    table = lambda d: {(r.rate, r.bin): r.n for r in quality.sketches(d, rules).collect()}
    both, x, y = table(a.union(b)), table(a), table(b)
    assert both == {k: x.get(k, 0) + y.get(k, 0) for k in x.keys() | y.keys()}


# -- secrets ------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    ]
    found = [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text, re.I | re.A if k == "assign" else 0) if ok(m)]
    order = [k for k, *_ in rules]
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def test_secret_base_spans(spark):
    rnd = random.Random(4)
    parts = ["password", "PassWd", "api_key", "apikey", "token", "=", ":", " ", '"', "'", "0123456789abcdef", "AKIA", "ABCDEFGH12", "x", "\n", "é", "ſecret", "==", "b7db7aa4", "-_/."]
    texts = [None, "", 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" é', "AKIA" * 5 + "1" * 9] + ["".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(400)]
    for r in secrets.scan(docs(spark, texts)).collect():
        want = brute_base(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, *_ in want) for kind in ("assign", "access", "hex")]
        assert not text or set(text.split(",")) <= set(r.spans.split(","))


def named(text):
    return [text[a:b] for k, a, b in secrets.spans(text)[1] if k == "named"]


def test_secret_lexing():
    text = 'DEFAULT = "s3cr3t-Value-9081"\nauth_key2 = DEFAULT\nname = "Hunter2Hunter9!x"\nprivateKey: "9fA8" + "-s77d-KKq2"\n'
    found = [(n, v) for n, _, v, _ in secrets.pairs(text)]
    assert ("auth_key2", "s3cr3t-Value-9081") in found and ("privateKey", "9fA8-s77d-KKq2") in found
    assert named(text) == ["s3cr3t-Value-9081", "9fA8", "-s77d-KKq2"]
    assert secrets.spans("password is what you type: hello there friends")[1] == []


V = "Zx81-kkQ2!88aa~PPq1"


@pytest.mark.parametrize(
    "text",
    [
        'signing_key: str = "{}"',
        "const apiSecretKey: string = '{}';",
        'auth_key: Optional[str] = "{}"',
        'String privateKey = "{}";',
        'var signing_key string = "{}"',
        'secret_key[] = "{}"',
        'conf["client-secret"]["x"] = "{}"',
        'private_keys = [\n  "{}",\n]',
        'set_signing_key("{}")',
        "define('DB_PASSWORD', '{}');",
        "connect(host, credential='{}')",
        "<signingKey>{}</signingKey>",
        '<entry key="db.passphrase">{}</entry>',
        '<add key="db.passphrase" value="{}"/>',
        "credentials:\n  prod:\n    main: '{}'",
        '{{"auth": {{"bearer": "{}"}}}}',
        '# signing_key = "{}"',
        "// signing_key := '{}'",
        'signing_key = \\\n  "{}"',
        'signing_key = Secret(b"{}")',
        'signing_key = """{}"""',
        "base = '{}'\nsigning_key = base",
        "signing_key = base\nbase = '{}'",
        "a = '{}'\nb = a\nsigning_key = b",
        "signing_key={}",
        "https://h/x?a=1&signing_key={}",
        "'signing_key' => '{}',",
    ],
)
def test_secret_forms(text):
    text = text.format(V)
    assert named(text) == [V], text
    assert V not in secrets.redacted(text) and ("base" not in text or "base" in secrets.redacted(text))


@pytest.mark.parametrize("text", ["token = os.getenv('SERVICE_TOKEN_V2')", "signing_key = config['signing_key_v2']", "key: https://example.org/a/Bc9/xyz12", "the key: see Figure12b, and the access: by road", "auth = parse(request)", "a < b and key > 3", "def private_key(self): return self.x1", "signing_key = None  # changeme", "key == 'Zx81-kkQ2!88aa~PPq1'"])
def test_what_is_no_secret(text):
    assert named(text) == []


def test_secret_values_joined_over_lines():
    text = 'signing_key = "Zx81-kk" +\n  "Q2!88aa"\n  + "~PPq1"\n'
    assert named(text) == ["Zx81-kk", "Q2!88aa", "~PPq1"]
    assert "Zx81" not in secrets.redacted("base = 'Zx81-kkQ2!88aa~PPq1'\nsigning_key = base")


@pytest.mark.parametrize(
    "text",
    [
        "key=" + "A9_b" * 250_000,
        "key = " + "x" * 500_000 + "=" + "y:" * 250_000,
        "key='" + "\\'" * 500_000,
        "key(" * 250_000,
        "key = a\n" * 100_000,
        "".join(f"key{i} = key{i - 1} + key{i - 1}\n" for i in range(1, 40_000)) + "key0 = 'ab'",
        'key="""' + "a" * 500_000 + "'''" * 100_000,
        "<key " * 200_000,
    ],
)
def test_secret_lexing_is_linear(text):
    began = time.perf_counter()
    secrets.spans(text)
    assert time.perf_counter() - began < 6


def test_lexing_survives_anything():
    rnd = random.Random(8)
    parts = ["key", "password", "token.x", "=", ":", " ", '"', "'", '"""', "(", ")", "[", "]", "{", "}", "<", ">", "</", ",", ";", "+", "\n", "\n  ", "\\", "#", "Zx81kkQ2", "é", "->", "`"]
    for _ in range(3000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 60)))
        base, found = secrets.spans(text)
        assert set(base) <= set(found) and all(0 <= a < b <= len(text) for _, a, b in found)
        assert (secrets.redacted(text) == text) == (not found)


def test_redaction(spark):
    frame = docs(spark, ["x password=b7db7aa4a5fcc78305 y", "clean text", None]).withColumnRenamed("lang", "batch")
    got = {r.doc_id: r for r in secrets.redact(frame).collect()}
    assert got[0].text == "x [secret] y" and got[0].n_chars == 12 and got[1].text == "clean text" and got[2].text is None
    assert secrets.redact(frame).columns == frame.columns and secrets.redact(frame.limit(0)).count() == 0


# -- BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(library):
    rnd = random.Random(6)
    texts = mixed_texts() + ["".join(rnd.choices("abcdethein", k=rnd.randint(300, 3000))) for _ in range(20)] + ["a" * 5000, " " * 3000, "\n" * 2000 + "x", "-" * 4000, "日本語" * 800, "ab" * 3000 + " " + "= " * 999]
    small, normal = bpe.TreeBPE(bpe.default_vocabulary(), text_leaf=50, piece_leaf=4), bpe.encoder(bpe.default_vocabulary())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert small.encode(text) == want.ids and normal.encode(text) == want.ids
        assert normal.decode_bytes(want.ids) == library.decode(want.ids, skip_special_tokens=False).encode()


def test_bpe_leaves_of_unsplit_text_run_in_threads(library):
    """A long run's leaves go to the native threads, and so do the other leaves of its text."""
    tree, seen = bpe.TreeBPE(bpe.default_vocabulary(), text_leaf=200), []
    batch = tree.native.encode_ordinary_batch
    tree.native.encode_ordinary_batch = lambda texts, num_threads: (seen.append(texts), batch(texts, num_threads=num_threads))[1]
    rnd = random.Random(4)
    alphabets = ["abcdefgh", "0123456789", "!?'-#", " \n\t\u3000", "日本語é", "𐍈ab", "'!̈¨", "ʼأنا"]
    for run in ["".join(rnd.choices(a, k=3000)) for a in alphabets]:
        for text in (run, " " + run, f"{'some words ' * 90}{run} {'and others ' * 90}"):
            seen.clear()
            assert tree.encode(text) == library.encode(text, add_special_tokens=False).ids
            assert max(map(len, seen)) > 1
    assert any(any(x.startswith(" and others") or x.startswith(" others") for x in texts) for texts in seen)


def test_bpe_of_every_code_point(library):
    """Each code point alone, between letters and before a space, in texts of a thousand."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(p + x for p in points[a : a + 1000]) for a in range(0, len(points), 1000) for x in ("a", " ", "")][: 3 * 200]
    texts += ["".join(points[a : a + 4000]) for a in range(200_000, len(points), 4000)]
    tree = bpe.encoder(bpe.default_vocabulary())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tree.encode(text) == want.ids


def test_bpe_refuses_ids_out_of_the_order_of_merging(tmp_path):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[-1], merges[-2] = merges[-2], merges[-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="order of merging"):
        bpe.TreeBPE(str(tmp_path / "v.json"))


def test_bpe_query(spark, library):
    texts = [None, *mixed_texts(30)]
    for r in bpe.round_trip(docs(spark, texts)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip(docs(spark, ["a"]).limit(0)).count() == 0
    assert bpe.encode_texts(docs(spark, ["hello world"])).first().token_ids == library.encode("hello world").ids


# -- token counts ---------------------------------------------------------------------


@pytest.mark.parametrize("whole_scores", [False, True])
def test_token_counts_equal_the_library(whole_scores):
    vocabulary = token_counts.zipf_vocabulary(token_counts.default_vocabulary())
    if whole_scores:  # many ties
        vocabulary = [(p, float(round(s))) for p, s in vocabulary]
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(vocabulary, remembered=50)
    texts = mixed_texts(300) + ["x" * 3000, "<0x0A> <s>", "plain words in a row"]
    assert [counter.text(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts)]


def test_token_counts_query(spark):
    frame = docs(spark, ["two words", None, "", "two words"])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame).collect()}
    assert got[1] == got[2] == 0 and got[0] == got[3] > 1
    assert token_counts.count_tokens(frame.limit(0)).count() == 0


# -- licences ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(8)
    return licenses.train([" ".join(rnd.choices(WORDS + ["water", "stone", "river", "software", "house", "version"], k=rnd.randint(5, 40))) for _ in range(800)])


def test_license_families(model):
    held_out = {
        "apache-2.0": "Copyright 2021 Jane. Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance",
        "mit": "It is released under the MIT License, as usual.",
        "gpl": "The tool is licensed under the GNU General Public License, version 3.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "cc-by-nc": "Pictures are licensed under CC BY-NC 4.0.",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    }
    assert {k: model.classify(v) for k, v in held_out.items()} == {k: k for k in held_out}
    assert model.classify("Licensed under the Fooland Public Data License, version 9.") == licenses.UNKNOWN
    for prose in ("a license to kill is a nice film", "he went to the public library", "", "only only only only mit mit"):
        assert model.classify(prose) == licenses.NONE


def test_license_held_out_accuracy(model):
    rnd = random.Random(99)
    data = [(w, c) for w, c in licenses.examples(["the river ran over stones and the house stood still"] * 50, rnd, copies=5) if w]
    right = sum(model.classify(" ".join(w)) == c for w, c in data)
    assert right / len(data) > 0.9
    # on phrases, and on families, that the folds' training didn't see
    assert model.seen_right > 0.85 and model.unseen_right > 0.6


def test_license_families_that_share_wording(model):
    grant = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    assert model.classify("This program is free software: " + grant.format("Affero General Public License")) == "agpl"
    assert model.classify("This program is free software: " + grant.format("General Public License")) == "gpl"
    got = {t: model.classify(t) for t in ("Licensed under CC BY-ND 4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY 4.0", "SPDX-License-Identifier: GPL-2.0-only", "This is free and unencumbered software released into the public domain.")}
    assert list(got.values()) == ["cc-by-nd", "cc-by-sa", "cc-by", "gpl", "unlicense"]
    for text in ("This file is licensed under the Server Side Public License, version 1", "Licensed under the Artistic License 2.0"):
        assert model.classify(text) == licenses.UNKNOWN


def test_license_wrapped_lines_and_odd_rows(spark, model):
    notice = ["# This program is free software: you can redistribute it and/or modify", "# it under the terms of the GNU General Public License as published by", "# the Free Software Foundation, either version 3 of the License, or", "# (at your option) any later version."]
    text = "Before.\n" + "\n".join(notice) + "\nAfter."
    assert licenses.find(model, text) == [("gpl", 8, len(text) - 7)]
    long = "Plain words of a text that goes on. " * 20_000 + "\n" + text
    rows = docs(spark, [text, text, long, None, ""]).selectExpr("*", "1 as n_licenses", "2 as families", "3 as spans")
    got = {r.doc_id: (r.n_licenses, r.families) for r in licenses.scan(rows, model).collect()}
    assert got == {0: (1, "gpl"), 1: (1, "gpl"), 2: (1, "gpl"), 3: (0, ""), 4: (0, "")}
    empty = rows.limit(0)
    assert licenses.scan(empty, licenses.train(licenses.negative_sample(empty, "doc_id", "text"))).count() == 0


def test_license_spans(spark, model):
    text = "Some prose here.\nReleased under the MIT License.\nMore prose."
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [text, None, "nothing"]), model).collect()}
    a = text.index("Released")
    assert got[0].spans == f"mit:{a}:{a + len('Released under the MIT License.')}" and got[0].families == "mit"
    assert got[1].n_licenses == got[2].n_licenses == 0


# -- HTML -----------------------------------------------------------------------------


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of you.</div>
{open}<h1>A title</h1><p>First &amp; foremost,\n a   paragraph with <b>bold</b> words<br>and enough of them to be content.</p><p>Yes.</p>
<form><label>Mail</label><input></form><p>Another paragraph that goes on for a while, so that it is content too.</p>{close}
<aside>Read this too, it is a sidebar with a good deal of text in it.</aside>
<section id="comments"><p>What a fine article, I have seldom read a better one in all of my life.</p></section>
<footer>&copy; nobody</footer></body></html>"""
WANT = "A title\n\nFirst & foremost, a paragraph with bold words and enough of them to be content.\n\nYes.\n\nAnother paragraph that goes on for a while, so that it is content too."


@pytest.mark.parametrize(("opened", "closed"), [("<article>", "</article>"), ("<div id=content>", "</div>"), ("<main><div class=body>", "</div></main>")])
def test_main_text(opened, closed):
    assert html_text.main_text(PAGE.format(open=opened, close=closed)) == WANT


PROSE = "A paragraph of the main text that goes on for long enough to be told from any short line beside it, whatever stands around it."


def test_regions_choose_among_all_lines():
    """An article is a hint: it neither hides text outside nor keeps every line inside."""
    body = f"<div>{f'<p>{PROSE}</p>' * 5}</div>"
    text = "\n\n".join([PROSE] * 5)
    byline = "<div><span>By</span><b>Ann</b></div><div><span>3</span><b>min</b></div><div><i>A</i><i>B</i></div>"
    assert html_text.main_text(f"<body>{body}<article><h4><i>A</i><b>b</b></h4><p><i>Or</i><b>not</b></p><p><a href=x>More</a></p></article></body>") == text
    assert html_text.main_text(f"<article>{byline}<header><h1>Heading</h1></header>{body}</article>") == f"Heading\n\n{text}"
    # an article's region takes in its shorter sections, which a higher threshold would have cut
    long, short = f"{PROSE} " * 40, "Some forty characters of text, or so it is."
    got = html_text.main_text(f"<article><section><p>{long}</p><p>{long}</p></section>{f'<section><p>{short}</p></section>' * 6}</article>")
    assert got == "\n\n".join([long.strip()] * 2 + [short] * 6)


PROSE = "This is the long paragraph that a reader came for, with many words in it and with no tags at all. " * 4


@pytest.mark.parametrize("name", "commentary related-work widget-text share-price notice-of-meeting menu-of-the-day promotion-history banner-years subscription-law".split())
def test_names_that_only_hold_a_word_lose_nothing(name):
    menu = "<nav><a href=x>Home</a></nav><div class='site-footer'><p>Imprint of the site</p></div>"
    assert html_text.main_text(f"<body>{menu}<div class='{name}'><p>{PROSE}</p></div></body>") == PROSE.strip()
    assert html_text.main_text(f"<body>{menu}<div><p>{PROSE}</p></div><article><p>{PROSE}</p><div id='{name}'><p>{PROSE}</p></div></article></body>").count("This is") == 12
    # beside the text that the page is about, a doubtful element goes
    assert html_text.main_text(f"<body>{menu}<div><p>{PROSE}{PROSE}</p></div><hr><section class='{name}'><p>{PROSE}</p></section></body>").count("This is") == (12 if name == "commentary" else 8)


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "ad_box2", "cookieBanner", "comments", "comment-list", "x related-posts", "newsletter"])
def test_names_of_known_parts(name):
    assert html_text.main_text(f"<div class='{name}'><p>{PROSE}</p></div>") == ""


@pytest.mark.parametrize("piece", ["<!--", "<a", "<a ", '<a href="', "<![CDATA[", "</", "<?", "<!", "<script>", "<title>", "&"])
def test_unfinished_markup_costs_linear_time(piece):
    began = time.perf_counter()
    assert html_text.main_text(f"<p>{PROSE}</p>" + piece * 50_000).startswith(PROSE.strip()[:50])
    assert time.perf_counter() - began < 5


def test_cut_off_markup_is_no_text():
    for end in ("<a hr", "<!-- not clo", "</di", '<img alt="x'):
        assert html_text.main_text(f"<p>{PROSE}</p><p>cut off {end}") == f"{PROSE.strip()}\n\ncut off"
    assert html_text.main_text("5 < 6 &amp; 7 <") == "5 < 6 & 7 <"


def brute_main_text(parts):
    """Text by the stated rules for pages of plain lines: (container, tags, text) in page order, no links, no <article>."""
    ratios = [len(t) / tags for _, tags, t in parts]
    weight = [math.exp(-0.5 * d * d) for d in range(4)]
    near = lambda n: [k for k in range(len(parts)) if abs(k - n) <= 3]
    smooth = [sum(ratios[k] * weight[abs(k - n)] for k in near(n)) / sum(weight[abs(k - n)] for k in near(n)) for n in range(len(parts))]
    mean = sum(smooth) / len(smooth)
    threshold = min(max(10.0, math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))), max(smooth))
    core = [x >= threshold - 1e-9 for x in smooth]
    strong = [up and r >= 10 for up, r in zip(core, ratios, strict=True)]
    strong = strong if any(strong) else core
    kept = []
    for n, (c, _, text) in enumerate(parts):
        own = [k for k, p in enumerate(parts) if p[0] == c]
        up = [own.index(k) for k in own if strong[k]]
        if up and (core[n] or up[0] - 5 <= own.index(n) <= up[-1] + 5):
            kept.append(text)
    return "\n\n".join(kept)


def unmarked_page(rnd):
    """Prose and short lines in plain <div>s: nothing but the ratio tells them apart."""
    html, parts = [], []
    for c in range(rnd.randint(2, 9)):
        wordy = rnd.random() < 0.4
        html.append("<div>")
        for _ in range(rnd.randint(1, 14)):
            text = "".join(rnd.choices("abcdefg", k=rnd.randint(60, 200) if wordy and rnd.random() < 0.7 else rnd.randint(1, 12)))
            inner = rnd.randint(0, 3)
            html.append("<p>" + "<i>" * inner + text + "</i>" * inner + "</p>")
            parts.append((c, text))
        html.append("</div>")
    return "<body>" + "".join(html) + "</body>", parts


def test_clusters_decide_on_pages_without_marks():
    """Against brute force on pages without article, class or id; and what clustering changes there."""
    rnd = random.Random(12)
    changed = 0
    for _ in range(150):
        html, parts = unmarked_page(rnd)
        parser = html_text.Lines()
        parser.feed(html)
        parser.close()
        assert [x[0] for x in parser.lines] == [t for _, t in parts]
        got = html_text.main_text(html)
        assert got == brute_main_text([(c, x[1], t) for (c, t), x in zip(parts, parser.lines, strict=True)])
        changed += got != "\n\n".join(t for _, t in parts)
    assert changed > 100


def test_boilerplate_that_only_the_ratio_tells():
    prose = "<p>" + "Long sentences of the text itself stand here, one after another. " * 4 + "</p>"
    junk = "".join(f"<p><b>{w}</b><i>x</i></p>" for w in ("Home", "News", "Shop", "Terms", "Top", "Press", "Jobs", "Help"))
    text = html_text.main_text(f"<body><div>{junk}</div><div>{prose * 3}<p>Yes.</p>{prose}</div><div>{junk}</div></body>")
    assert "Yes." in text and not any(w in text for w in ("Home", "Shop", "Terms", "Help"))


@pytest.mark.parametrize("html", ["<section>" * 20_000 + "</article>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<div>" + "<i>" * 20_000 + "<p></p>" * 20_000, "<li><b>" * 20_000, "<table>" + "<tr><td>x" * 20_000])
def test_stray_tags_cost_linear_time(html):
    began = time.perf_counter()
    html_text.main_text(html)
    assert time.perf_counter() - began < 5


def test_repeated_and_long_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(5000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "v", None)], "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as _html", "3 as n_chars")
    got = sorted((r.page_id, r.n_chars) for r in html_text.extract(pages).collect())
    size = len("\n\n".join(f"Paragraph {i} of a long page." for i in range(5000)))
    assert got == [(1, size), (1, size), (2, 0)]


def test_broken_pages(spark):
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>menu</nav>") == ""
    assert html_text.main_text('<p>unclosed <b>bold<p>two<script>var a="</p>') == "unclosed bold\n\ntwo"
    assert html_text.main_text("<article>" * 3000 + "deep" + "</div>" * 10) == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE.format(open="<article>", close="</article>")), (2, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {1: ("u", WANT, len(WANT)), 2: (None, "", 0)}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_smoothing_keeps_constants():
    import numpy as np

    assert np.allclose(html_text.smoothed(np.full(9, 3.0), 1.0), 3.0)


@pytest.mark.parametrize("prefix", ["", "f", "r", "b", "u", "Rb", "fR"])
def test_letters_before_a_literal_are_no_secret(prefix):
    value = "Zx81qLw9Tn4RbV6kPd2s"
    text = f'private_key = {prefix}"{value}"\nother = 1\n'
    _, added = secrets.spans(text)
    assert [text[a:b] for _, a, b in added] == [value]
    # a name that ends in such a letter is one
    text = f'auth_key = "{value}"\nf = auth_key\n'
    assert [text[a:b] for _, a, b in secrets.spans(text)[1]] == [value]


@pytest.mark.parametrize(
    ("paragraph", "families"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["mit", "apache-2.0"]),
        ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause)", ["gpl", "bsd"]),
        ("SPDX-License-Identifier: CC-BY-4.0", ["cc-by"]),
        ("Creative Commons Attribution 4.0 International (CC BY 4.0)", ["cc-by"]),
        ("License :: OSI Approved :: BSD License", ["bsd"]),
        ("License: GPLv2+", ["gpl"]),
        ('  "license": "MIT",', ["mit"]),
        ("Dual licensed under the MIT and GPL licenses.", ["mit", "gpl"]),
        ("This file may be used under the MIT or the ISC license.", ["mit", "isc"]),
        ("Released under the MIT License, copyright by the authors and others.", ["mit"]),
        ("License: a matter for the court and the city", []),
        ("the river ran over the house, or the stone", []),
    ],
)
def test_declared_and_several_licenses(model, paragraph, families):
    assert model.families(paragraph) == families
    found = licenses.find(model, f"first line\n{paragraph}\n{paragraph}\nLast line")
    assert sorted(k for k, *_ in found) == sorted(families) and all((a, b) == (11, 12 + 2 * len(paragraph)) for _, a, b in found)
