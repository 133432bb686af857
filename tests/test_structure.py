"""Left-over lines, table routes, element trees, notes, comments, styles, table functions and keyed upserts."""

import hashlib
import random
from html.parser import HTMLParser


from palimpsest.operators import diff, merging, pairing, table_functions, trees
from palimpsest.sources.tables import hashed_lines
from palimpsest.streaming import state


def tables(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(texts) - 1, 2)], "a_id long, b_id long")
    return pairs, hashed_lines(docs)


def tokens(line):
    return "".join(c if c.isalnum() else " " for c in line).lower().split()


def plain_residual_pairs(a, b):
    held_a, held_b = set(a), set(b)
    a, b = [tokens(x) for x in a if x not in held_b], [tokens(x) for x in b if x not in held_a]
    if not a or not b or len(a) > 6:
        return []
    long = lambda t: [x for x in t if len(x) >= 4]
    found = []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if not x or not y:
                continue
            sx, sy, lx, ly = set(x), set(y), long(x), long(y)
            shared = len(set(lx) & set(ly))
            short, body = max(len(sx), len(sy)) <= 8, max(len(sx), len(sy)) <= 16
            end = body and bool(lx) and bool(ly) and lx[-1] == ly[-1]
            connected = short and i == 0 and not shared and bool(sx & sy & {"and", "the", "for"})
            prefix = next((k for k, (p, q) in enumerate(zip(lx, ly)) if p != q), min(len(lx), len(ly)))
            begins = len(b) <= 20 and prefix >= 2
            further = i >= 1 and j > i and bool(lx) and lx[-1] not in pairing.SAYS_NOTHING and lx[-1] in y and max(len(a), len(b)) <= 4 and body
            least = 1 if end or connected or begins or further else 2 if short else 3
            if shared < least and not connected and not begins:
                continue
            s = len(sx & sy) / len(sx | sy)
            if s + 1e-12 >= (0.10 if end and short else 0.05 if end or further else 0.10 if connected or begins else 0.25):
                found.append((3 if end else 2 if further else 1, s, i, j))
    used_i, used_j, out = set(), set(), []
    for tier, s, i, j in sorted(found, key=lambda r: (-r[0], -r[1], r[3], r[2])):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j, tier))
    return sorted(out, key=lambda r: r[1])


def test_residual_pairs(spark):
    rng = random.Random(3)
    pool = ["this", "document", "and", "the", "for", "heading", "demo", "bold", "style", "visual", "text", "blue", "of", "a", "module", "finance", "review"]
    texts = ["\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(1, rng.choice([4, 9, 14])))) for _ in range(rng.randint(1, rng.choice([3, 7, 9])))) for _ in range(160)]
    got = {}
    for r in pairing.residual_pairs(*tables(spark, texts)).collect():
        got.setdefault(r["a_id"], []).append((r["i"], r["j"], r["tier"]))
    want = {k: plain_residual_pairs(texts[k].split("\n"), texts[k + 1].split("\n")) for k in range(0, 160, 2)}
    assert got == {k: v for k, v in want.items() if v} and {t for v in got.values() for *_, t in v} == {1, 2, 3}


def test_dominant_diagonals(spark):
    a = "red green blue\nlarge small wide\n- -"
    rows = {r["a_id"]: (r["wins"], r["dominant"]) for r in pairing.diagonal_dominant(*tables(spark, [a, "red green teal\nlarge small tall\n- -", a, "large small wide\nred green blue\n- -", a, "red\ngreen"])).collect()}
    # two unlike lines and one of no tokens, which is alike in its place; the crossed pair wins there alone
    assert rows == {0: (3, True), 2: (1, False)}


def test_table_routes_and_rows(spark):
    t = [f"a{k} | b{k} | c{k}" for k in range(8)]
    loose = ["a1 |  b1 | c1" if k in (1, 2, 3) else x for k, x in enumerate(t)]
    spaced = [x.replace("b", " b") if k in (1, 2, 3) else x for k, x in enumerate(t)]
    merged = [*t[:3], "x |  | y"]
    texts = ["\n".join(x) for x in (t, t, t, spaced, t, loose, merged, merged[::-1], merged, t, t, t[1:])]
    pairs, hashed = tables(spark, texts)
    routes = {r["a_id"]: r["route"] for r in pairing.table_routes(pairs, hashed).collect()}
    assert routes == {0: "place", 2: "content", 4: "general", 6: "place", 8: "place and remainder", 10: "general"}
    rows = {}
    for r in pairing.table_rows(pairs, hashed).collect():
        rows.setdefault(r["a_id"], {})[r["status"]] = r["n"]
    assert rows[0] == {"Equal": 8} and rows[2] == {"Equal": 5, "Deleted": 3, "Inserted": 3} and rows[8] == {"Equal": 3, "Unknown": 1, "Inserted": 4} and rows[10] == {"Equal": 7, "Deleted": 1}


def test_word_matches(spark):
    df = spark.createDataFrame([(1, "It is centered text of the page", "Both is of centered bold text to be"), (2, None, "x"), (3, "", "")], "k long, a string, b string")
    every = sorted(tuple(r) for r in pairing.word_matches(df, ["k"], "a", "b").collect())
    some = sorted(tuple(r) for r in pairing.word_matches(df, ["k"], "a", "b", eligible=True).collect())
    assert every == [(1, 1, 1), (1, 2, 3), (1, 3, 5)] and some == [(1, 1, 1), (1, 2, 3)]
    assert "text" in pairing.BOILER and len(pairing.GLUE) == 4


class Plain(HTMLParser):
    """The same tree with another parser, by nested lists."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = ["", [], None]
        self.open = [self.root]
        self.text = ""

    def flush(self):
        words = " ".join(self.text.split())
        if words:
            self.open[-1][1].append(words)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = [tag, [], None]
        self.open[-1][1].append(node)
        if tag not in trees.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.open[-1][1].append([tag, [], None])

    def handle_endtag(self, tag):
        self.flush()
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text += data


def plain_elements(html):
    p = Plain()
    p.feed(html)
    p.close()
    p.flush()
    out = []

    def walk(node, parent, depth, path):
        number = len(out)
        out.append(None)
        parts, seen = [], {}
        for x in node[1]:
            if isinstance(x, str):
                parts.append(">" + x)
            else:
                seen[x[0]] = seen.get(x[0], 0) + 1
                parts.append("<" + walk(x, number, depth + 1, f"{path}/{x[0]}:{seen[x[0]]}"))
        digest = hashlib.sha1("".join([node[0], *parts]).encode()).hexdigest()
        out[number] = (number, parent, depth, node[0], path, len(out) - number - 1, digest)
        return digest

    seen = {}
    for x in p.root[1]:
        if not isinstance(x, str):
            seen[x[0]] = seen.get(x[0], 0) + 1
            walk(x, None, 0, f"/{x[0]}:{seen[x[0]]}")
    return out


def test_elements_against_another_parser(spark):
    rng = random.Random(5)
    pages = ["", "no tags", "<p>a<b>c</p>d</b>", "<div><br><p>x</div></p>", "</p><ul><li>a<li>b</ul>", "a < b <i>c</i>"]
    for _ in range(200):
        pages.append("".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<br>", "<b class='x'>", "</b>", "one ", "  two", "<img src=a />"]) for _ in range(rng.randint(0, 25))))
    for html in pages:
        assert trees.elements_of(html) == plain_elements(html), html
    df = spark.createDataFrame([*enumerate(pages), (900, None)], "page_id long, html string")
    got = {}
    for r in trees.elements(df, "page_id", "html").collect():
        got.setdefault(r["page_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in ((k, plain_elements(h)) for k, h in enumerate(pages)) if v}


def test_deep_pages_are_linear():
    import time

    began = time.process_time()
    assert trees.elements_of("<div>" * 20_000)[0][5] == 19_999
    assert time.process_time() - began < 30


def test_largest_shared_subtrees(spark):
    box = "<div><ul><li>a</li><li>b</li></ul><p>c</p></div>"
    df = spark.createDataFrame([(1, f"<main>{box}x</main>"), (2, f"<main>{box}y</main>"), (3, "<ul><li>a</li><li>b</li></ul>")], "page_id long, html string")
    found = trees.elements(df, "page_id", "html")
    got = {(r["holders"], r["copies"], r["first"]) for r in trees.shared_subtrees(found, "page_id").collect()}
    assert got == {(2, 2, 1), (3, 3, 1)}  # the box, and its list, which the third page has without it


def test_ranges_and_what_lies_inside(spark):
    html = "ab<b>cd</b>e<b>f</b>&x</i><i>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    stream = trees.tag_stream(df, "page_id", "html")
    assert [(r["name"], r["closes"], r["offset"]) for r in stream.orderBy("seq").collect()] == [("b", False, 2), ("b", True, 4), ("b", False, 5), ("b", True, 6), ("i", True, 8), ("i", False, 8)]
    assert sorted((r["name"], r["start"], r["end"]) for r in trees.ranges_of(stream, "page_id", "name").collect()) == [("b", 2, 4), ("b", 2, 6)]
    found = spark.createDataFrame([(1, "a", 1, 9), (1, "b", 2, 3), (1, "c", 4, 12), (1, "d", 13, 14)], "page_id long, name string, opened int, closed int")
    marks = spark.createDataFrame([(1, 1, False), (1, 9, True), (1, 11, False), (1, 13, True)], "page_id long, seq int, closes boolean")
    # both ends count, also of two ranges; an end that is a mark itself is not inside
    assert {r["name"]: r["inside"] for r in trees.inside_ranges(found, "page_id", marks).collect()} == {"a": False, "b": True, "c": True, "d": False}


def test_union_of_comments(spark):
    schema = "g long, id long, parent long, text string"
    b = [(1, 0, None, "one"), (1, 1, 0, "two"), (1, 2, 1, "three")]
    a = [(1, 0, None, "one"), (1, 1, 0, "other"), (1, 2, 1, "more"), (1, 3, 2, "kept"), (1, 5, 3, "also kept"), (2, 0, None, "alone")]
    out = merging.union_comments(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "g").where("side = 'a'").collect()
    # the free numbers from 3 on, without 3 and 5, are 4 and 6; replies follow
    assert sorted((r["g"], r["id"], r["parent"], r["text"]) for r in out) == [(1, 3, 6, "kept"), (1, 4, 0, "other"), (1, 5, 3, "also kept"), (1, 6, 4, "more"), (2, 0, None, "alone")]


def test_inherited_styles(spark):
    rows = [("a", None, {"font": "x", "size": "1"}), ("b", "a", {"size": "2"}), ("c", "b", {"color": None}), ("d", "lost", {"size": "3"}), ("e", "f", {"k": "e"}), ("f", "e", {"k": "f", "l": "f"}), ("g", "c", None)]
    schema = "id string, based_on string, props map<string,string>"
    got = {r["id"]: dict(r["props"]) for r in merging.effective_props(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": {"font": "x", "size": "1"}, "b": {"font": "x", "size": "2"}, "c": {"font": "x", "size": "2", "color": None}, "d": {"size": "3"}, "e": {"k": "e", "l": "f"}, "f": {"k": "f", "l": "f"}, "g": {"font": "x", "size": "2", "color": None}}
    new = [("a", None, {"font": "y", "size": "1"}), ("b", "a", {"size": "2"}), ("c", "b", {"size": "2", "color": None}), ("d", "lost", {}), ("h", None, {"z": "1"})]
    out = sorted(tuple(r) for r in merging.revised_styles(spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema)).collect())
    # b changes by its ancestor alone; c declares what it inherits, but inherits another font, so it is listed
    assert out == [("a", "font", "x", "y"), ("c", "size", None, "2"), ("d", "size", "3", None)]


def test_note_revisions(spark):
    schema = "doc long, note long, text string"
    a = spark.createDataFrame([(1, 1, "the old note"), (1, 2, "gone"), (1, 3, "same"), (1, 4, None)], schema)
    b = spark.createDataFrame([(1, 1, "the new note"), (1, 3, "same"), (1, 5, "come")], schema)
    got = sorted((r["note"], r["rev_no"], r["type"], r["text"], r["part"]) for r in merging.note_revisions(a, b, ["doc", "note"]).collect())
    assert got == [(1, 1, "Deleted", "old", "footnotes"), (1, 2, "Inserted", "new", "footnotes"), (2, 1, "Deleted", "gone\n", "footnotes"), (5, 1, "Inserted", "come\n", "footnotes")]


def test_table_functions(spark):
    table_functions.register(spark)
    rows = spark.sql("select seq_no, status, text from diff_units('a b', 'a c')").collect()
    assert [tuple(r) for r in rows] == [(k, *x) for k, x in enumerate(diff.aligned("a b", "a c", True))]
    assert [r["unit"] for r in spark.sql("select unit from text_units('a, b\\nc')").collect()] == ["a", ",", " ", "b", "\n", "c", "\n"]
    assert spark.sql("select * from text_units(null)").count() == 0


def test_upserts_survive_replays(spark, tmp_path):
    schema = "user_id long, ts long, value string"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    path = str(tmp_path / "state")
    read = lambda: sorted(tuple(r) for r in state.current_table(spark, path, schema).collect())
    assert read() == []
    first, second = batch((1, 5, "a"), (2, 5, "b"), (1, 4, "old")), batch((1, 6, "c"), (2, 4, "late"), (3, 1, "d"))
    state.upsert_batch(first, 0, path, ["user_id"], ["ts"])
    state.upsert_batch(second, 1, path, ["user_id"], ["ts"])
    want = [(1, 6, "c"), (2, 5, "b"), (3, 1, "d")]
    assert read() == want
    state.upsert_batch(second, 1, path, ["user_id"], ["ts"])
    state.upsert_batch(first, 0, path, ["user_id"], ["ts"])
    assert read() == want


def test_upsert_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(3):
        spark.createDataFrame([(u, 10 * k + u, f"v{k}") for u in range(4)], "user_id long, ts long, value string").coalesce(1).write.mode("append").parquet(source)
    rows = spark.readStream.schema("user_id long, ts long, value string").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second start finds nothing new
        state.upsert_stream(rows, path, ["user_id"], ["ts"], str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in state.current_table(spark, path, "user_id long, ts long, value string").collect()) == [(u, 20 + u, "v2") for u in range(4)]
