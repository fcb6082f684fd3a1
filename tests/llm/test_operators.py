"""Small fixtures for the training-data operators: brute force, round trips and odd rows."""
from __future__ import annotations

import hashlib
import html
import math
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from dossier.llm import (chat_format, common, decontamination, html_wrappers, line_dedup, lm_scoring, mixing, quality_rules,
                         simhash, substring_dedup, url_trust)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy int, _id int, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 9, 8, "x") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, clashing names."""
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 90))) for _ in range(12)]
    rows = [(k, t, "s%d" % (k % 3)) for k, t in enumerate(base)]
    passage = " ".join(base[0].split()[:40])
    rows += [(20, "a b " + passage + " c d", "s0"), (21, base[1] + "\n" + base[2], None), (22, base[1], "s1"),
             (23, base[3] + " tail", "s2"), (24, "", "s1"), (25, None, "s1"), (26, " \n\t ", None), (None, base[4], "s0"),
             (None, None, None), (27, base[5], "s2"), (27, base[5], "s2"), (28, "Ä ß " * 4000, "s0"), (29, "word", "s1"),
             (30, "l1\nl2\nl3\nl4\nl5\nl6\nl7\nl8\nl9", "s0"), (31, "new\nl1\nl2\nl3\nl4\nl5\nl6\nl7\nl8\nl9\nend", "s0")]
    return rows


def test_quality_ledger_counts_and_policies(spark, odd):
    rows = quality_rules.judged(quality_rules.ledger(docs_of(spark, odd))).collect()
    assert len(rows) == len(odd)
    for r in rows:
        texts = {t or "" for i, t, _ in odd if i == r["doc_id"]}
        assert any(r["n_words"] == len(t.split()) and r["word_chars"] == sum(map(len, t.split())) for t in texts)
    eight = " ".join("abcdefgh")
    docs = docs_of(spark, [(1, eight + " x " + eight, None), (2, " ".join(["a"] * 12), None), (3, "q\nq\n\nq", None)])
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    assert got[1]["n_repeat_words"] == 16 and got[2]["n_repeat_words"] == 12 and got[3]["n_dup_lines"] == 2
    assert got[2]["n_stutter_words"] == 11
    led = quality_rules.ledger(docs_of(spark, odd))
    bits = [r["fail_bits"] for r in led.collect()]
    for r in quality_rules.ablation(led).collect():
        bit = quality_rules.BITS[r["rule"]]
        assert (r["failed"], r["only_this"]) == (sum(1 for b in bits if b & bit), sum(1 for b in bits if b == bit))
        assert r["kept_without"] == sum(1 for b in bits if not b & ~bit)
    assert quality_rules.ledger(docs_of(spark, [])).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> <<SYS>> <|end|>", "", None, "a<|text|>b<|start|>", "\\", "<", "[\\INST]", "Ä 😀"]
    rows = [(c, k, role, t) for c, roles in ((1, "uaua"), (2, "uuaa"), (3, "saau")) for k, (role, t) in
            enumerate((r, texts[(c * 3 + j) % len(texts)]) for j, r in enumerate(roles * 3))]
    rows += [(4, 0, None, "x"), (4, 0, "a", "tie"), (4, 0, "a", "tie"), (4, None, "<|start|>", "role"), (None, 1, "u", "y")]
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(c, k, names.get(r, r), t) for c, k, r, t in rows]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit(1))
    made = chat_format.formatted(given).select("conv_id", "formatted", "pieces", chat_format.read_turns(F.col("formatted")).alias("t"),
                                               chat_format.read_loss(F.col("pieces")).alias("loss")).collect()
    assert len(made) == 5
    for m in made:
        own = sorted(((-1 if k is None else k, r or "", t or "") for c, k, r, t in rows if c == m["conv_id"]))
        assert [(x["role"], x["text"]) for x in m["t"]] == [(r, t) for _, r, t in own]
        assert m["loss"] == "".join(t for _, r, t in own if r == "assistant")
        assert m["formatted"] == "".join(p["text"] for p in m["pieces"])
    assert chat_format.formatted(given.limit(0)).count() == 0


def test_url_rules_and_link_walk(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [(1, "http://A.Example.com/de/x?q", ""), (2, "https://x.example.net/en/", None), (3, "http://b.net/", link("c.org")),
             (4, "nothing", ""), (5, None, None), (6, "http://c.org/fr/1", link("good.com", "good.com")), (7, "http://c.org/en", link("b.net")),
             (8, "http://bad.com/1", link("b.net")), (9, "http://good.com/1", ""), (9, "http://good.com/1", ""), (10, "http://net", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in url_trust.verdicts(df).collect()}
    assert url_trust.verdicts(df).count() == len(pages)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/de/x", "example.com/de/", "block")
    assert (got[2]["rule"], got[3]["rule"], got[6]["rule"], got[10]["rule"]) == ("example.net/en/", "net/", "org/fr/", None)
    assert got[4]["host"] == got[5]["path"] == "" and got[5]["verdict"] == "allow"
    assert got[8]["verdict"] == "block" and got[9]["verdict"] == "allow" and got[9]["trust"] > 0
    # brute force over the same graph
    edges = {("b.net", "c.org"): 1.0, ("c.org", "good.com"): 2 / 3, ("c.org", "b.net"): 1 / 3, ("bad.com", "b.net"): 1.0}
    rank = own = {"c.org": 0.5 / 1.5 * 0.15, "x.example.net": 1 / 1.5 * 0.15}
    for _ in range(20):
        new = Counter(own)
        for (a, b), w in edges.items():
            new[b] += 0.85 * rank.get(a, 0) * w
        rank = new
    assert got[9]["trust"] == pytest.approx(rank["good.com"] / sum(rank.values()), abs=1e-5)
    assert url_trust.verdicts(df.limit(0)).count() == 0


def test_decontamination_blocks_agree_with_brute_force(spark, odd):
    items = [(1, " ".join((odd[0][1] or "").split()[5:30])), (2, "word"), (3, None), (4, "!!"), (10, " ".join(odd[3][1].upper().split()[:10])), (None, "tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, odd)
    words = lambda t: decontamination.normal_words((t or "").encode())
    want = []
    for i, t, _ in odd:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            g = words(text)
            k = min(10, len(g))
            for s in range(len(g) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p:p + k] == g[s:s + k]:
                        hit.update(range(p, p + k))
                        found.update([] if item is None else [str(item)])
        want.append((i or -1, len(w), len(hit), tuple(sorted(found))))
    for block in (500_000, 3):
        got = decontamination.scan(docs, bench, block).select("doc_id", "n_words", decontamination.hit_words(F.col("spans")).alias("h"), "items")
        assert sorted((r[0] or -1, r[1], r[2], tuple(r[3])) for r in got.collect()) == sorted(want)
        kept = decontamination.clean_documents(docs, bench, block)
        assert kept.count() == sum(1 for x in want if not x[2]) and kept.columns == docs.columns
    assert decontamination.scan(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    assert decontamination.without_spans("One, two; three.", [(1, 2)]) == "One, ; three."


def test_html_wrappers(spark):
    page = ('<html><head><title>t</title></head><body><nav><a>menu</a></nav><!-- x --><div class="side-bar ad">buy</div>{}'
            '<section class="comments"><p>me too</p></section><form>q</form><script>var a="</p>";</script><footer>&copy;</footer></body>')
    article = "<article><h1>A &amp; B</h1><p><b>bo</b>ld  x<br>y<p>two\n three</article>"
    plain = "<div id=c><p>long text {} of words</p><ul><li><a href=x>l</a></li></ul></div>"
    rows = [(1, "http://h/1", page.format(article)), (2, "http://h/2", page.format(article.replace("<h1>A &amp; B</h1>", ""))),
            (3, "http://g/", page.format(plain.format(1))), (3, "http://g/", page.format(plain.format(1))), (4, None, None),
            (5, "x", ""), (6, "http://h/3", "<p>unclosed <i>tag <a href='"), (7, "http://h/4", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("wrapper", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_wrappers.extracted(df).collect()}
    assert html_wrappers.extracted(df).count() == len(rows)
    assert got[1] == "A & B bold x y two three" and got[2] == "bold x y two three"
    assert got[3] == "long text 1 of words" and got[4] == got[5] == "" and got[7] == "deep"
    first = html_wrappers.wrapper_of("<ul><li>a</li><li>b</li></ul><p>x</p>")
    both = html_wrappers.aligned(first, html_wrappers.wrapper_of("<ul><li>a</li></ul>"))
    assert [n[:2] for n in both] == [["ul", ""], ["p", "?"]] and both[0][2][0][:2] == ["li", "+"]
    assert html_wrappers.extracted(df.limit(0)).count() == 0
    assert html.unescape("&lt;") == "<"


def test_line_chunks_shift_and_stay_whole(spark, odd):
    docs = docs_of(spark, odd)
    for r in docs.select("text", line_dedup.chunks(F.col("text")).alias("c")).collect():
        assert "\n".join(c["text"] for c in r["c"]) == (r["text"] or "")
    lines = ["line %d of a passage" % k for k in range(40)]
    shared = docs_of(spark, [(1, "\n".join(lines), None), (2, "\n".join(["front"] + lines + ["back"]), None)])
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(shared).collect()}
    assert got[1]["text"] == "\n".join(lines)
    left = got[2]["text"].split("\n")
    assert left[0] == "front" and left[-1] == "back" and len(left) < 20 and got[2]["_before"]["lines"] == 42
    done = line_dedup.without_repeats(docs)
    assert done.count() == len(odd) and done.columns == [*docs.columns, "_before", "_after"]
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark, odd):
    docs = docs_of(spark, odd)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(odd) and rows == mixing.mixed(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mixed(docs).collect()))
    sizes = Counter()
    for _, t, s in odd:
        sizes[s] += len((t or "").split())
    taken, largest, target = Counter(), Counter(), {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] and t <= 2 * sizes[s] + 1e-9
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixing.mixture(docs).count() == sum(r["copies"] for r in rows)
    assert mixing.mixed(docs.limit(0)).count() == 0
    given = spark.createDataFrame([("b", 10), ("a", 1000), (None, 10), ("c", 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(given).collect()}
    assert got == {"b": 20, None: 20, "c": 200, "a": pytest.approx(1.5 * 1120 - 240)}


def test_base_scores_equal_brute_force(spark, odd):
    docs = docs_of(spark, odd)
    train = Counter()
    for i, t, _ in odd:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(lm_scoring.tokens((t or "").encode()))
    n, v = sum(train.values()), len(train)
    rows = lm_scoring.scores(docs).collect()
    assert len(rows) == len(odd)
    for r in rows:
        bases = []
        for t in [t for i, t, _ in odd if i == r["doc_id"]]:
            w = list(lm_scoring.tokens((t or "").encode()))
            bases.append((len(w), sum(x in train for x in w), sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)))
        assert any(b[:2] == (r["n_tokens"], r["n_known"]) and abs(b[2] - r["base_score"]) < 1e-9 for b in bases)
        assert r["train_tokens"] == n and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    assert lm_scoring.scores(docs.limit(0)).count() == 0


def test_substring_dedup_equals_brute_force(spark, odd):
    docs = docs_of(spark, odd)
    seen = Counter()
    for _, t, _ in odd:
        w = (t or "").split()
        seen.update(tuple(w[k:k + 35]) for k in range(len(w) - 34))
    want = []
    for i, t, _ in odd:
        w = (t or "").split()
        gone = {p for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for p in range(k, k + 35)}
        want.append((i if i is not None else -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.without_repeats(docs).select("doc_id", "n_words", substring_dedup.removed_words(F.col("spans")), "kept").collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == sorted(want)
    assert any(x[2] and x[3] for x in want)
    assert substring_dedup.factors([(0, 0b11), (2, 0b1), (50, 0b101)]) == [(0, 37), (50, 87)]
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0


def test_simhash_components_equal_brute_force(spark, odd):
    rng = random.Random(3)
    base = odd[6][1].split() * 3
    near = [(100 + k, " ".join(w if rng.random() > 0.004 else "zz" for w in base), None) for k in range(60)]
    rows = odd + near
    docs = docs_of(spark, rows)
    got = simhash.near_duplicates(docs).collect()

    def print_of(text):
        w = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if w else 0

    prints = [print_of(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min((x for x in (least.get(root[k]), i) if x is not None), default=None)
    want = sorted(str((i, p - (1 << 64) if p >> 63 else p, least[root[k]])) for k, ((i, _, _), p) in enumerate(zip(rows, prints)))
    assert sorted(str(tuple(r)) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 200)], "u long, v long")
    assert {r["node"]: r["root"] for r in simhash.components(chain).collect()} == {**{k: 0 for k in range(31)}, 100: 100, 200: 100}


def test_similar_documents_are_verified(spark, odd):
    """Every link has a similarity of 0.8 or more, and no pair far above it stays apart."""
    rng = random.Random(4)
    base = odd[6][1].split() * 4
    rows = list(odd)
    for noise in (0.002, 0.01, 0.03, 0.06):
        rows += [(int(noise * 100_000) + k + 200, " ".join(w if rng.random() > noise else "z%d" % rng.randrange(99) for w in base),
                  None) for k in range(25)]
    docs = docs_of(spark, rows)
    got = [tuple(r) for r in simhash.similar(docs).collect()]
    assert len(got) == len(rows)

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]

    def parts(least):
        root = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
        names = {r: min((i for k, (i, _, _) in enumerate(rows) if root[k] == r and i is not None), default=None) for r in root}
        return sorted(((rows[k][0], names[root[k]]) for k in range(len(rows))), key=str)

    loose, strict = parts(0.8), parts(0.9)
    # a component found lies inside one at 0.8, and one at 0.9 lies inside a component found
    wide, found = {i: c for i, c in loose if i is not None}, {i: c for i, c in got if i is not None}
    assert all(wide[i] == wide[c] for i, c in found.items())
    assert all(found[i] == found[c] for i, c in strict if i is not None)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == {c for i, c in got if i == c} - {None}
    assert simhash.similar(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_words_are_ascii_space_separated(spark):
    text = "\x0b a b\x1cc\td  e "
    row = spark.createDataFrame([(text,)], "t string").select(common.words(F.col("t")).alias("w")).first()
    assert row["w"] == [w.decode() for w in text.encode().split()]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pipeline_stages(spark, odd, tmp_path):
    import corpus_pipeline
    good = [(i, t, s) for i, t, s in odd]
    docs_of(spark, good).drop("copy", "_id", "kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(odd[7][1].split()[:20]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r["doc_id"] for r in docs.collect()}
    assert 7 not in left and 24 not in left and 29 not in left and {0, 2, 3, 8} <= left
    assert not {22, 1} <= left
    mix = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in mix.collect()} <= left
