"""Preference formatting, the capture index and license templates."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import captures, licenses, preference, queries

TURNS = "conv_id bigint, turn bigint, role string, text string"

# ---- preference pairs


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def render(turns):
        text, mask = "", []
        for role, body in turns:
            text += f"<|im_start|>{role}\n"
            if role == "assistant":
                mask.append((len(text), len(text) + len(body) + len("<|im_end|>")))
            text += f"{body}<|im_end|>\n"
        return text, mask

    return (n, render(chosen[:n])[0], *render(chosen[n:]), *render(rejected[n:]))


def formatted(spark, chosen, rejected):
    sides = [spark.createDataFrame(rows, TURNS).withColumn("id", F.lit("own")).withColumn("turns", F.lit("own")) for rows in (chosen, rejected)]
    return {r.id: (r.prompt_turns, r.prompt, r.chosen, [tuple(m) for m in r.chosen_mask], r.rejected, [tuple(m) for m in r.rejected_mask]) for r in preference.format_preferences(*sides).collect()}


def test_preference_cases(spark):
    long = "é" * 300_000
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    cases = {
        1: ([u, a], [u, b]), 2: ([u, a], [u, a]), 3: ([u, a, u], [u, a]), 4: ([a], [b]), 5: ([u, ("", ""), a], [u, ("", ""), b]),
        6: ([("user", long), ("assistant", long + "1")], [("user", long), ("assistant", long + "2"), u]), 7: ([u, u, a], [u, u, b]),
    }
    rows = [[(i, k, r or None, t or None) for i, sides in cases.items() for k, (r, t) in enumerate(sides[s])] for s in (0, 1)]
    random.Random(1).shuffle(rows[0])
    rows[0] += [(None, 0, "user", "x"), (8, 0, "user", "alone")]
    assert formatted(spark, *rows) == {i: plain(*sides) for i, sides in cases.items()}


def test_preference_order_of_ties_and_null_numbers(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "first"), (1, 0, "assistant", "z"), (1, 0, "assistant", "z")]
    got = formatted(spark, rows, rows)[1]
    assert got[0] == 5
    assert re.findall(r">(\w+)\n(\w+)<", got[1]) == [("system", "first"), ("assistant", "z"), ("assistant", "z"), ("user", "a"), ("user", "b")]


def test_preference_empty(spark):
    assert formatted(spark, [], []) == {}


def test_masks_cover_answers_only(spark):
    from tests.conftest import SF

    for r in preference.format_pairs(preference.with_stale_answer(spark.read.parquet(f"{SF}/conversations.parquet"))).collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert [text[s:e] for s, e in mask] == [t + "<|im_end|>" for t in re.findall(r"<\|im_start\|>assistant\n(.*?)<\|im_end\|>", text, re.S)]


# ---- capture index

PAGES = "page_id bigint, url string, html string"


def indexed(spark, rows, block_lines=3, page_blocks=2, partitions=3):
    pages = spark.createDataFrame(rows, PAGES).withColumn("file", F.lit("own")).withColumn("url_key", F.lit("own")).withColumn("__u", F.lit("own")).repartition(partitions)
    entries = captures.archive(pages)
    return pages, entries, captures.build_index(entries, block_lines, page_blocks)


def test_every_capture_is_found_and_read(spark):
    r = random.Random(3)
    rows = [(i, f"http://www.h{r.randrange(5)}.example.com/p{r.randrange(12)}?b={r.randrange(2)}&a=1#x", f"<p>{i}</p>" * r.randrange(50)) for i in range(120)]
    rows += [(500 + i, "https://hot.example.org/", f"v{i}") for i in range(40)]  # one key over many blocks and pages
    rows += [(7, "http://tie.example.org/a", "one"), (7, "http://tie.example.org/a", "one"), (None, "http://tie.example.org/a/", None), (900, None, "x"), (901, "  ", "x"), (902, "http://é.example/\t", "long" * 500_000)]
    rows += [(903, "http://b.example/\r\n\r\nx", "an empty line in the URL"), (904, "http://b.example/\r\nContent-Length: 0\r\n\r\n", "a header in the URL"), (905, "http://c.example/", "Content-Length: 3\r\n\r\nin the page")]
    pages, entries, directory = indexed(spark, rows)
    got = captures.read_ranges(captures.lookup(directory, captures.url_key(pages.select("url")))).collect()
    want = sorted((i if i is not None else -1, hashlib.sha256((h or "").encode()).hexdigest()) for i, u, h in rows if u and u.strip())
    assert sorted((g.page_id if g.page_id is not None else -1, g.sha256) for g in got) == want


def test_index_is_sorted_and_sparse(spark):
    _, _, directory = indexed(spark, [(i, f"http://h{i % 7}.org/{i}", "x") for i in range(100)])
    rows, reader = sorted(directory.collect(), key=lambda b: b.number), captures.Reader()
    keys = [key for b in rows for key in captures.lines_of(reader.read(b.file, b.offset, b.length))[0]]
    assert keys == sorted(keys) and len(keys) == 100
    assert [b.first_key for b in rows] == sorted(b.first_key for b in rows) and all(b.lines <= 3 for b in rows)


def test_a_lookup_of_one_key_reads_one_block_and_one_range(spark, monkeypatch):
    _, entries, directory = indexed(spark, [(i, f"http://h{i % 7}.org/{i}", "page " * i) for i in range(200)], block_lines=10, page_blocks=4)
    seen, read = [], captures.Reader.read
    monkeypatch.setattr(captures.Reader, "read", lambda self, *place: seen.append(place) or read(self, *place))
    rows = entries.where("page_id = 77").collect()[0]
    page = next(p for p in sorted({d.page for d in directory.collect()}, reverse=True) if min(d.first_key for d in directory.collect() if d.page == p) < rows.url_key)
    hits = captures._search(pa.table({"url_key": [rows.url_key]}), directory.where(F.col("page") == page).toArrow())
    assert len(seen) == 1 and hits.num_rows == 1
    out = list(captures._read(iter(hits.to_batches())))
    assert seen[1:] == [(rows.file, rows.offset, rows.length)] and out[0].column("n_bytes").to_pylist() == [5 * 77]
    assert sum(length for *_, length in seen) < 0.05 * sum(r.length for r in entries.collect())
    plan = captures.read_ranges(captures.lookup(directory, entries.select("url_key")))._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan and "binary" not in plan


def test_files_are_warc(spark):
    import gzip

    _, entries, _ = indexed(spark, [(1, "http://a.org/x y", "<p>é</p>")], partitions=1)
    path = entries.first()["file"].removeprefix("file:")
    with gzip.open(path) as f:
        records = f.read().split(b"WARC/1.0\r\n")[1:]
    fields = [dict(line.split(b": ", 1) for line in r.split(b"\r\n\r\n")[0].split(b"\r\n")) for r in records]
    assert [f[b"WARC-Type"] for f in fields] == [b"warcinfo", b"response"] and all(f[b"WARC-Date"] and f[b"WARC-Record-ID"] for f in fields)
    assert fields[1][b"WARC-Target-URI"] == b"http://a.org/x%20y"
    assert int(fields[1][b"Content-Length"]) == len(records[1].split(b"\r\n\r\n", 1)[1]) - 4
    assert records[1].split(b"\r\n\r\n", 1)[1].startswith(b"HTTP/1.1 200 OK\r\n")


def test_absent_keys_find_nothing(spark):
    _, _, directory = indexed(spark, [(1, "http://b.org/m", "x")])
    for key in ("org,a)/", "org,b)/m0", "org,b)/l", "zz"):
        assert captures.lookup(directory, spark.createDataFrame([(key,)], "url_key string")).count() == 0


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://WWW.Example.com:80/A/?b=2&a=1#f", "com,example)/a?a=1&b=2"), ("https://user:pw@m.x.org", "org,x,m)/"), ("x.org/?", "org,x)/"), ("http://x.org:8080/a//", "org,x:8080)/a"),
        ("", None), (None, None),
    ],
)
def test_url_keys(spark, url, key):
    assert captures.url_key(spark.createDataFrame([(url,)], "url string")).first()["url_key"] == key


def test_capture_index_empty(spark):
    assert captures.index_and_look_up(spark.createDataFrame([], PAGES)).count() == 0


# ---- licenses


def match(template, text):
    return licenses.Automaton(licenses.parse(template)).find(licenses.tokens(text))


@pytest.mark.parametrize(
    ("template", "text", "places"),
    [
        ("a b c", "x A, b\nC y a b c", [(1, 5), (6, 9)]),
        ("a <<beginOptional>>b<<endOptional>> c", "a c a b c a b b c", [(0, 2), (2, 5)]),
        ("a <<beginOptional>>b <<beginOptional>>d<<endOptional>><<endOptional>> c", "a b d c. a b c, a d c", [(0, 4), (4, 7)]),
        ('a <<var;name="x";original="y";match="[0-9]+">> c', "a 12 c a x c", [(0, 3)]),
        ('by <<var;name="x";original="y";match=".+">> end', "by one two end", [(0, 4)]),
        ('by <<var;name="x";original="y";match=".+">> end', "by one\ntwo end", []),
        ('by <<var;name="x";original="y";match=".*">> end', "by end", [(0, 2)]),
        ('v <<var;name="x";original="3";match="3(.0)?">>', "v 3.0 v 3 v 3.1", [(0, 2), (2, 4)]),
        ("a b", "a x b", []), ("a b", "", []),
        ("licence terms", "License TERMS", [(0, 2)]),
    ],
)
def test_templates(template, text, places):
    assert match(template, text) == places


@pytest.mark.parametrize("bad", ["a <<beginOptional>>b", "a <<endOptional>> b"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        licenses.parse(bad)
    with pytest.raises(ValueError):
        licenses.anchors(licenses.parse("<<beginOptional>>a<<endOptional>>"))


def test_own_templates_match_their_original():
    for name, template in licenses.TEMPLATES.items():
        text = re.sub(r'<<var;.*?original="(.*?)".*?>>', r"\1", template, flags=re.S)
        bare = re.sub(r"<<(begin|end)Optional>>", " ", text)
        assert match(template, f"Before. {bare} \nafter"), name
        words = bare.split()
        if len(words) > 40:  # with a word changed it is another text
            words[9] = "changed"
            assert not match(template, " ".join(words)), name


def plain_find(template, text):
    """All matches by regular expressions over the tokens, from each place the longest."""
    words = licenses.tokens(text)
    pattern, out, at = re.compile(licenses._regex(licenses.parse(template))), [], 0
    while at < len(words):
        ends = [e for e in range(at + 1, len(words) + 1) if words[at] != "\n" and words[e - 1] != "\n" and pattern.fullmatch(" ".join(words[at:e]) + " ")]
        if ends:
            out.append((at, ends[-1]))
        at = ends[-1] if ends else at + 1
    return out


@pytest.mark.parametrize("template", [
    "a b", "a <<beginOptional>>b<<endOptional>> c", 'a <<var;name="x";original="b";match=".+">> c', '<<beginOptional>>a <<var;name="x";original="b";match=".*">><<endOptional>> c',
    'a <<var;name="x";original="b";match="[bc]">> <<beginOptional>>c <<beginOptional>>a<<endOptional>> b<<endOptional>>', '<<var;name="x";original="b";match=".{0,9}">> c a',
])
def test_matches_are_those_of_a_plain_search(template):
    r = random.Random(7)
    for _ in range(120):
        text = " ".join(r.choice(["a", "b", "c", "\n"]) for _ in range(r.randint(0, 14)))
        assert match(template, text) == plain_find(template, text), (template, text)


def test_a_million_words_on_one_line_take_seconds():
    import time

    for text in ("copyright " * 1_000_000, "copyright x all rights reserved " * 200_000, "copyright all " * 500_000):
        began = time.perf_counter()
        match(licenses.TEMPLATES["Reserved"], text)
        assert time.perf_counter() - began < 20


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "Own-1.0.template.txt").write_text("own <<beginOptional>>short<<endOptional>>\nlicense text")
    (tmp_path / "Other.txt").write_text("other words")
    got = licenses.load_templates(spark, str(tmp_path))
    assert sorted(got) == ["Other", "Own-1.0"] and match(got["Own-1.0"], "Own license\ntext") == [(0, 4)]


def test_scan_cases(docs_of, none):
    line = "Licensed under the Apache License, Version 2.0."
    rows = [(1, line, "s"), (1, line, "s"), (None, f"x {line} {line}", None), (2, None, None), (3, "", "s"), (4, "licensed under the apache", "s"), (5, "word " * 200_000 + line, "s")]
    got = sorted(((r.doc_id or -1, r.license, r.matches, r.first_token) for r in licenses.scan(docs_of(rows)).collect()))
    assert got == [(-1, "Apache-2.0", 2, 1), (1, "Apache-2.0", 1, 0), (1, "Apache-2.0", 1, 0), (5, "Apache-2.0", 1, 200_000)]
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize("name", ["op1_preference_format", "op6_capture_index", "op7_license_templates"])
def test_against_sql(compare, name):
    compare(queries.QUERIES[name], queries.ORACLES[name])
