import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import canonical, knn, langid, mixing, neardup, ocr, pii, queries, splitting, tokenise, truncation

random.seed(5)


def test_ids_equal_a_plain_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenise.DEFAULT_VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=tokenise.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, " ", "aaaaaaa  b\n  c", "a\x00b c", "'ll don't <|endoftext|>", "किराया 3,27,500 ₹", "🙏🏽" * 40, "zz" * 4000, "a \n b  "] + ["".join(random.choices("ab  \n'é₹1", k=60)) for _ in range(200)]
    flat, ends = tokenise.encoder(tokenise.DEFAULT_VOCABULARY).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [plain.encode_ordinary(t or "") for t in texts]


def test_encode_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenise.encode_corpus(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2
    assert tokenise.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,same", [("ｆｅｅ of", "fee of", True), ("of fice", "of fice", True), ("oﬃce", "office", True), ("café", "café", True), ("sha​ll", "shall", True), ("ОТМЕН paper", "ОТМЕН paper", True), ("раrty", "party", True), ("сору", "copy", True), ("cafe", "café", False), ("４", "४", False), ("a\r\nb", "a\nb", False), ("Case", "case", False), ("α", "a", False), ("№ 5", "No 5", False), ("𝐟𝐞𝐞", "fee", True), ("ℒaw", "Law", True), ("օwner", "owner", True), ("ᎪᏟᎢ", "ACT", True), ("ⅲ", "iii", True), ("x²", "x2", False), ("½", "1/2", False), ("Հայերեն", "Հայերեն", True), ("հայ", "hայ", True)])
def test_one_form(a, b, same):
    assert (canonical.one_form(a) == canonical.one_form(b)) is same


def test_look_alike_pairs(spark):
    rows = [(1, "the fee"), (2, "the ｆｅｅ"), (3, "the fee"), (4, None), (5, " "), (6, "​"), (7, "The fee"), (8, "the fee")]
    got = {tuple(r) for r in canonical.look_alike_pairs(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8)}


def test_look_alike_classes(spark):
    rows = [(1, "the fee"), (2, "the ｆｅｅ"), (3, "the fee"), (4, None), (5, " "), (7, "The fee")]
    df = spark.createDataFrame(rows, "k long, text string")
    assert {tuple(r) for r in canonical.look_alike_classes(df, "k", "text").collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (7, 7, 1)}
    assert canonical.look_alike_classes(df.limit(0), "k", "text").count() == 0


def test_near_pairs_equal_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(40):
        base = random.choices(words, k=80)
        rows.append((3 * k, " ".join(base)))
        changed = list(base)
        for i in random.sample(range(80), 2):
            changed[i] = "new"
        rows.append((3 * k + 1, " ".join(changed)))
        rows.append((3 * k + 2, " ".join(base).upper().replace(" ", " ")))
    rows += [(900, None), (901, "too short"), (902, "")]
    got = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, "chunk_no long, text string")).collect()}
    long = [(k, t) for k, t in rows if t and len(neardup.words_of(t)) >= 20]
    want = {(a, b) for i, (a, x) in enumerate(long) for b, y in long[i + 1 :] if neardup.similarity(x, y) >= 0.7}
    assert want and got == want


def test_long_runs_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HELD", 3)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"x{k}"])) for k in range(12)] + [(100 + k, " ".join(random.choices(base, k=30))) for k in range(30)]
    got = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, "chunk_no long, text string")).collect()}
    assert got == {(a, b) for a in range(12) for b in range(a + 1, 12)}


def test_variants_meet_within_the_radius():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << neardup.BITS, 300)
    group = rng.integers(0, 3, 300)
    i, j = neardup.meeting(group, code, np.zeros(300, np.int64))
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and bin(code[a] ^ code[b]).count("1") <= neardup.RADIUS}
    assert set(zip(i.tolist(), j.tolist())) == want
    alone = neardup.meeting(group, code, np.zeros(300, np.int64), neardup._CHANGES[:1])  # no ball: equal codes only
    assert len(alone[0]) < len(want) / 10


def test_nearest_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 64)) * 40
    v = np.clip(centres[rng.integers(0, 30, 600)] + rng.normal(size=(600, 64)) * 6, -127, 127).astype(int)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0] * 64), (702, [1, 2])]
    df = spark.createDataFrame(rows, "chunk_no long, vec array<byte>")
    got = {(r.query, r.near) for r in knn.nearest(df, df.where("chunk_no % 50 = 0").select("chunk_no")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -9)
    want = {(i, int(j)) for i in range(0, 600, 50) for j in np.argsort(-cos[i])[:10]}
    assert len(got & want) >= 0.95 * len(want)


def test_nearest_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 20)
    rows = [(i, [1, 2] + [0] * 62) for i in range(200)] + [(1000 + i, [3, i - 50] + [1] * 62) for i in range(100)]
    df = spark.createDataFrame(rows, "chunk_no long, vec array<byte>")
    got = knn.nearest(df, window=40).collect()
    assert {r.query for r in got} == {k for k, _ in rows} and max(r.rank for r in got) == 10
    by = {q: [r.near for r in sorted((r for r in got if r.query == q), key=lambda r: r["rank"])] for q in (0, 150)}
    assert all(len(set(v)) == 10 and q not in v and max(v) < 200 for q, v in by.items())  # a vector shared by most rows fills many ranges
    assert knn.nearest(df.limit(0)).count() == 0 and knn.nearest(df.limit(1)).count() == 0


def test_hilbert_curve_is_a_walk():
    cells = np.array([(x, y) for x in range(16) for y in range(16)])
    order = cells[np.argsort(knn.hilbert_keys(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_pieces_rebuild_texts(spark):
    texts = [None, "", "short", "x" * 3000, ("A sentence here. " * 300), "a\n" * 2000]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "chunk_no long, text string, heading string")
    got = splitting.split_pieces(df, range_size=500).orderBy("chunk_no", "piece_no").collect()
    for i, t in enumerate(texts):
        out = ""
        for r in (r for r in got if r.chunk_no == i):
            assert len(r.piece) <= 1200 and r.piece_start <= len(out) and r.heading == "h"
            out = out[: r.piece_start] + r.piece
        assert out == (t or "")
    cuts = {r.chunk_no: r.cut for r in splitting.boundary_gaps(df, range_size=500).collect()}
    assert cuts == {3: "forced", 4: "natural", 5: "natural"}


def test_giant_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splitting, "FAN", 3)
    text = "An é sentence; " * 5000 + "é" * 3000 + "x\n" * 900
    raw = text.encode()
    (tmp_path / "f.txt").write_bytes(raw)
    out = b""
    (tmp_path / "short.txt").write_bytes(b"short")
    (tmp_path / "empty.txt").write_bytes(b"")
    got = splitting.split_files(spark, [str(tmp_path / f) for f in ("f.txt", "short.txt", "empty.txt")], range_size=3001).orderBy("path", "piece_no").collect()
    assert [bytes(r.piece) for r in got if "short" in r.path] == [b"short"] and not [r for r in got if "empty" in r.path]
    mine = [(r.piece_start, r.piece_start + len(bytes(r.piece).decode()), r.cut) for r in got if r.path.endswith("/f.txt")]
    assert mine == splitting.text_pieces(text) == splitting.text_pieces(text, size=997)  # the same pieces whatever the ranges
    assert b"".join(bytes(r.piece)[: len(text[a : mine[k + 1][0] if k + 1 < len(mine) else b].encode())] for k, (r, (a, b, _)) in enumerate(zip([r for r in got if r.path.endswith("/f.txt")], mine))) == raw
    assert [r.piece_no for r in got if r.path.endswith("/f.txt")] == list(range(len(mine)))
    assert splitting.split_files(spark, [str(tmp_path / "empty.txt")]).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1199, 5000])
def test_stretches_by_ranges(size):
    for text in ("", "a. b", "é" * 3000, "x. " * 900, "a\n" * 700 + "ü" * 1300 + ". end", "." + " " * 2500):
        at = [m.start() for m in __import__("re").finditer(r"\n|(?<=[.;:?!]) ", text)]
        want = max([b - a - 1 for a, b in zip([-1, *at], [*at, len(text)])])
        assert splitting.longest_stretch(text, size=size) == want

def test_mixture_shares(spark):
    docs = [(i, "big" if i % 3 else "small", "word " * 20) for i in range(900)] + [(2000, None, "x"), (2001, "small", None), (2002, "other", "x y")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(df, targets)
    report = {r.source: r for r in mixing.share_report(drawn, targets).collect()}
    assert abs(report["big"].actual_share - 0.5) < 0.01 and report["none"].tokens == 0
    assert report["small"].most_repeats == 2 and drawn.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_truncation(spark):
    whole = ["It ends here.", "Done\nDate: 3 May 2011", "x y\n\nSd/-\nRegistrar, Town", "All of it.\n[End of notice]", "क्या है?", "He said “so.”", None, "", "  ", "text here.\n* * *"]
    cut = ["the balan...", "It is [more]", "the bui�", "ends in the mid", "यह आधा", "No officer in charge shall ", "paid Rs.", "First part.\n9."]
    df = spark.createDataFrame([(i, t, None if i % 2 else "s") for i, t in enumerate(whole + cut)], "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.truncated(df).where("cut").collect()}
    assert got == set(range(len(whole), len(whole) + len(cut)))


def test_hidden_limit(spark):
    rows = [(i, "w" * random.randint(50, 180) + ".", "s") for i in range(200)] + [(1000 + i, "é" * 98 + "abcd", "s") for i in range(60)]
    seen = truncation._inspected(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    limits = truncation.hidden_limits(seen).collect()
    assert [(r.encoding, r.limit) for r in limits if not r.passed] == [("bytes", 200)]
    assert {(r.encoding, r.limit) for r in limits if r.encoding == "chars"} <= {("chars", 102 + k) for k in range(4)}


def test_every_limit_of_a_source(spark):
    rows = [(i, "w" * random.randint(50, 180) + ".", "s") for i in range(300)]
    rows += [(1000 + i, "w" * 90, "s") for i in range(150)] + [(2000 + i, "w" * 250, "s") for i in range(40)]
    got = {r.doc_id: r for r in truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k].cut and got[k].limit_by for k in (1000, 1149, 2000, 2039))


def test_limits_decide_doubtful_endings(spark):
    """The same ending is cut at a limit and whole away from it."""
    rows = [(i, "w" * random.randint(50, 180) + ".", "s") for i in range(800)] + [(1000 + i, "w" * 400, "s") for i in range(150)]
    rows += [(3000 + i, "w" * 391 + " paid Rs.", "s") for i in range(5)]
    rows += [(4000 + i, "w" * random.randint(20, 90) + " paid Rs.", "t") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in truncation.truncated(df).collect()}
    assert {got[3000 + i].ending for i in range(5)} == {got[4000].ending} == {"loose"}
    assert all(got[3000 + i].cut for i in range(5)) and not any(got[4000 + i].cut for i in range(40))
    assert all(got[1000 + i].cut for i in range(150)) and not any(got[i].cut for i in range(800))
    assert truncation.truncated(df.limit(0)).count() == 0


def test_languages(spark):
    docs = [("en", "the owner shall pay the rent on time and the notice is sent"), ("hinglish", "mujhe kiraya nahi mila aur malik ne notice bheja hai"), ("hi", "मुझे किराया नहीं मिला और मालिक ने नोटिस भेजा है"), ("mr", "मला भाडे मिळाले नाही आणि मालकाने नोटीस पाठवली आहे")]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    s = langid.Scorer(model)
    assert [s.sentence(t)[0] for _, t in docs] == [lang for lang, _ in docs]
    assert s.sentence("123 ...") == ("und", 0.0, 0)
    m = spark.createDataFrame([(1, "user", "the owner shall pay the rent. मुझे किराया नहीं मिला।"), (2, "user", None), (3, "user", "...")], "msg_no long, role string, content string")
    labels = spark.createDataFrame([(1, "en-IN"), (2, "hi"), (3, None)], "msg_no long, language string")
    assert [tuple(r) for r in langid.unnamed_languages(m, labels, model).collect()] == [(1, "hi")]


@pytest.mark.parametrize("text,want", [
    ("Call my sister Bhavitra D'Almora on 67582 72294 if I do not answer.", ["name", "phone"]),
    ("My name is B. Thekkaran and I live at Flat 8B, Malhar Apartments, Mango Grove Road, Morvikota - 599767.", ["name", "address"]),
    ("I am Fathila Solankar, my PAN or other id is 5308 1152 7488.", ["name", "identity"]),
    ("Refund should go to 90655326708915381, and confirm on mistrapal_m@nyay.example.", ["account", "email"]),
    ("Order no. 3216660474 came to Mandavgarh on time.", []), ("The bill number is 33147593 and the amount is Rs. 670755.", []),
    ("वसीयत में मेरा नाम नहीं है, क्या मुझे हिस्सा मिलेगा?", []), ("", []), (None, []),
    ("मेरा नाम शमीमा हसनवी है और फ़ोन नंबर ७४३६०१७२९२ है।", ["name", "phone"]), ("Write to imraan69 at mail[.]example today.", ["email"]),
])
def test_personal_data(text, want):
    assert [pii.LABELS[lab] for lab, _, _ in pii.items([text])[0]] == want


def test_masking_keeps_the_rest():
    t = "Please send the draft to osonthavi-6@nyay.example. Thanks"
    assert pii.masked_text(t, pii.items([t])[0]) == "Please send the draft to [EMAIL]. Thanks"


_FILLER = "the rent for the said premises was paid on time and the receipt was kept by the office of the society for the record. " * 12


@pytest.mark.parametrize("again", ["Velmuri", "Velmurl", "VELMURI"])
def test_skip_links_carry_labels(again):
    """A name that stands again far from every sign, spelt alike or nearly so, is found by its link only."""
    text = f"My name is Kamlika Velmuri and I rent a flat. {_FILLER}After that {again} was asked to leave. {_FILLER}In the end {again} went."
    found = lambda model: [text[a:b] for lab, a, b in pii.items([text], model)[0] if lab == pii.N]
    on = pii.prior()
    assert found(on) == ["Kamlika Velmuri", again, again]  # along two links to the third occurrence
    assert found(pii.Model(on.node, on.chain, 0.0)) == ["Kamlika Velmuri"]


def test_messages_settle():
    d = pii._Doc(text := "My name is Kamlika Velmuri. " + "and then Velmuri came. " * 30, pii.signs(text))
    net, model = pii._Net([d]), pii.prior()
    belief, equal = pii.beliefs(net, net.unary(model.node), model)
    assert len(d.links) == 30 and 15 < equal <= 30
    label = belief.argmax(1)
    assert all(label[k] == pii.N for k, t in enumerate(d.tokens) if t == "Velmuri")


def test_chain_beliefs_equal_enumeration():
    import itertools

    d = pii._Doc(text := "call Asha Rane, 98234 55510", pii.signs(text))
    net, model = pii._Net([d]), pii.prior()
    u = net.unary(model.node)[:4]
    net.n, net.starts, net.lengths = 4, np.array([0]), np.array([4])
    net.a = net.b = np.zeros(0, np.int64)
    got = pii.beliefs(net, u, model)[0]
    p = np.zeros((4, 7))
    for labels in itertools.product(range(7), repeat=4):
        w = np.exp(sum(u[k, x] for k, x in enumerate(labels)) + sum(model.chain[x, y] for x, y in zip(labels, labels[1:])))
        for k, x in enumerate(labels):
            p[k, x] += w
    q = np.exp(got - got.max(1, keepdims=True))
    assert np.allclose(q / q.sum(1, keepdims=True), p / p.sum(1, keepdims=True), atol=1e-6)


def test_weights_are_fitted_to_placeholders():
    rows = [(f"Please reach me on {n} or at ravi{n}@mail.example today.", "Please reach me on [PHONE] or at [EMAIL] today.") for n in range(9811100000, 9811100040)]
    assert [x[0] for x in pii.weak_labels(*rows[0])] == [pii.P, pii.E] and pii.weak_labels("a", "a") == [] == pii.weak_labels("a b", "c [PHONE]")
    fitted = pii.fit(rows)
    k = pii._AT["mobile"]
    assert fitted.node[k, pii.P] > pii.prior().node[k, pii.P]
    assert [pii.LABELS[x] for x, _, _ in pii.items([rows[3][0]], fitted)[0]] == ["phone", "email"]
    assert (pii.fit([]).node == pii.prior().node).all()


def test_page_repair(spark):
    good = "The tenant shall pay the settled rent within the said month.\nThe notice shall be served on the owner without delay."
    rows = [(i, f"d{i % 8}", i // 8 + 1, f"Lease Deed Town 5\n\n{good}\n\nPage {i // 8 + 1}", "vision") for i in range(40)]
    rows += [(100, "d0", 6, "Lease Deed Town 5\n\nThe tenant sha1l pay the sett-\nled rent within the said month.\n\nPage 6", "vision"), (101, "d1", 6, None, None), (102, "d1", 7, "", "text")]
    df = spark.createDataFrame(rows, "page_no long, doc_id string, page int, text string, via string")
    got = {(r.line_no, r.kind) for r in ocr.line_faults(df).where("page_no = 100").collect()}
    assert got == {(1, "header"), (3, "char"), (3, "hyphen"), (6, "pageno")}
    paras = [r.text for r in ocr.paragraphs(df).where("doc_id = 'd0'").orderBy("para_no").collect()]
    assert paras[-1] == "The tenant shall pay the settled rent within the said month."
    assert ocr.line_faults(df.limit(0)).count() == 0


def test_misreadings():
    assert ocr.misread_of("sha1l", "shall") and ocr.misread_of("deared", "cleared") and ocr.misread_of("nohfy", "notify")
    assert not ocr.misread_of("shall", "shall") and not ocr.misread_of("street", "shall")
    assert ocr.skeleton("forthvvith") == ocr.skeleton("forthwith")


def test_context_tells_a_word_from_a_misreading(spark):
    """'it' may be a misread 'if', and is a word: its neighbours decide."""
    rows = [(i, f"d{i}", 1, "The order says if the rent is due and if the rent is late then if the owner asks.") for i in range(60)]
    rows += [(100 + i, f"e{i}", 1, "The owner said that it shall stand and the tenant agreed.") for i in range(20)]
    rows += [(200, "x", 1, "The order says it the rent is due and"), (201, "y", 1, "it shall stand and the tenant agreed."), (202, "y", 2, "if the rent is late then if the owner asks.")]
    df = spark.createDataFrame(rows, "page_no long, doc_id string, page int, text string")
    assert {(r.page_no, r.line_no) for r in ocr.line_faults(df).where("kind = 'char'").collect()} == {(200, 1)}


def test_first_words_of_pages_are_judged(spark):
    good = "The tenant shall pay the settled rent within the said month and leave."
    rows = [(i, f"d{i}", 1, good) for i in range(30)]
    rows += [(100, "x", 1, "The tenant shall pay the settled rent"), (101, "x", 2, "w1thin the said month and leave."), (102, "y", 1, "The tenant shall pay the set-"), (103, "y", 2, "tled rent within the said month and leave.")]
    df = spark.createDataFrame(rows, "page_no long, doc_id string, page int, text string")
    assert {(r.page_no, r.line_no, r.kind) for r in ocr.line_faults(df).collect()} == {(101, 1, "char"), (102, 1, "hyphen")}


def test_every_hyphen_breaks_a_word(spark):
    good = "The tenant shall pay the settled rent within the said month."
    rows = [(i, f"d{i}", 1, good) for i in range(10)]
    rows += [(100 + i, f"x{i}", 1, f"The tenant shall pay the sett{sign}{' ' * (i % 2)}\nled rent within the said mon{sign}") for i, sign in enumerate(ocr.HYPHENS)]
    rows += [(200 + i, f"x{i}", 2, "th.") for i in range(len(ocr.HYPHENS))]
    df = spark.createDataFrame(rows, "page_no long, doc_id string, page int, text string")
    assert set(ocr.HYPHENS) == set("-‐‑­¬")
    got = {(r.page_no, r.line_no) for r in ocr.line_faults(df).where("kind = 'hyphen'").collect()}
    assert got == {(100 + i, k) for i in range(len(ocr.HYPHENS)) for k in (1, 2)}
    assert {r.text for r in ocr.paragraphs(df).collect()} == {good}
    words = {r.word for r in ocr._Plan(df).forms.collect()}
    assert not words & {"set", "sett", "led", "mon"} and not any(w[-1] in ocr.HYPHENS for w in words)


def test_all_tables_are_masked(spark, tmp_path):
    text, want = "Please send the draft to osonthavi-6@nyay.example. Thanks", "Please send the draft to [EMAIL]. Thanks"
    for t, key, column in (("messages", "msg_no", "content"), ("extracted_pages", "page_no", "text"), ("input_verdicts", "msg_no", "sanitised")):
        rows = [(1, text), (2, None), (3, ""), (4, "No case")] + [(1, text)] * (t == "messages")
        spark.createDataFrame(rows, f"{key} long, {column} string").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = [tuple(r) for r in queries.p7_masked(spark, str(tmp_path)).select("src", "row_key", "text").collect()]
    each = [(1, want), (2, None), (3, ""), (4, "No case")]
    assert sorted(map(repr, got)) == sorted(repr((t, *r)) for t in ("messages", "extracted_pages", "input_verdicts") for r in each + [(1, want)] * (t == "messages"))


def test_forms_of_documents_and_chunks(spark, tmp_path):
    rows = [(1, "the ｆｅｅ"), (2, None), (3, ""), (4, "раrty"), (5, "plain")]
    for t, key in (("documents", "doc_id"), ("chunks", "chunk_no")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = {(r.tab, r.key, r.text) for r in queries.p3_forms(spark, str(tmp_path)).collect()}
    want = [(1, "the fee"), (2, None), (3, ""), (4, "party"), (5, "plain")]
    assert got == {(t, *r) for t in ("documents", "chunks") for r in want}


def test_mixture_gives_on_what_a_source_leaves(spark):
    docs = [(i, "abc"[i % 3], "word " * (3 + i % 9)) for i in range(900)] + [(5000 + i, "tiny", "word word") for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.25, 1), ("c", 0.25, 1), ("tiny", 0.25, 2)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(df, targets, budget=2000).collect()
    assert sum(r.tokens for r in drawn) <= 2000 and 2000 - sum(r.tokens for r in drawn) < 20
    assert sum(r.source == "tiny" for r in drawn) == 6  # it runs out, the others have the rest alike
    had = [sum(r.tokens for r in drawn if r.source == s) for s in "abc"]
    assert max(had) - min(had) <= 20 and sum(had) > 1900
    assert sorted(r.queued for r in drawn) == [sum(x.tokens for x in sorted(drawn, key=lambda x: x.queued)[: k + 1]) for k in range(len(drawn))]
    assert mixing.draw(df.limit(0), targets).count() == 0


def test_mixture_over_many_slices_and_ranges(spark, monkeypatch):
    docs = [(i, "ab"[i % 2], "word " * (3 + i % 9)) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 3)], "source string, target_share double, max_repeats int")
    want = sorted(map(tuple, mixing.draw(df, targets).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 40)
    monkeypatch.setattr(mixing, "QUEUE_ROWS", 100)
    assert sorted(map(tuple, mixing.draw(df, targets).collect())) == want


def test_mixture_is_in_queue_order(spark, tmp_path):
    docs = [(i, "big" if i % 3 else "small", "word " * (5 + i % 7)) for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    got = queries.p9_mix(spark, str(tmp_path)).collect()
    assert len(got) > 600 and [r.finish for r in got] == sorted(r.finish for r in got)
    # at every moment the two sources are apart by no more than a document each
    had = {"big": 0, "small": 0}
    for r in got:
        had[r.source] += r.tokens
        assert abs(had["big"] - had["small"]) <= 2 * max(x.tokens for x in got)


def test_misread_halves(spark):
    good = "The tenant shall pay the settled rent within the said month."
    rows = [(i, f"d{i}", 1, good) for i in range(30)]
    rows += [(100, "x", 1, "The tenant shall pay the 5et-\ntled rent within the said month."), (101, "y", 1, "The tenant shall pay the set-\nt1ed rent within the said month.")]
    rows += [(102, "z", 1, "The tenant shall pay the set-"), (103, "z", 2, "t1ed rent within the said month."), (104, "z", 2, "t1ed rent within the said month.")]
    rows += [(105, "v", 1, "The tenant shall pay the 5et-\nt1ed rent within the said month."), (106, "w", 1, "The tenant shall pay the set-\ntled rent within the said month.")]
    df = spark.createDataFrame(rows, "page_no long, doc_id string, page int, text string")
    got = {(r.page_no, r.line_no) for r in ocr.line_faults(df).where("kind = 'char'").collect()}
    assert got == {(100, 1), (101, 2), (103, 1), (104, 1), (105, 1), (105, 2)}
