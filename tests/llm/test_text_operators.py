"""Operators on single texts: against the libraries, brute force and round trips, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter as Tally

import numpy as np
import pytest

from weir.llm import chunks, decontamination, fingerprints, licenses, line_dedup, pii, piece_sampling, token_counts, token_files, toxicity
from weir.llm.queries import vocabulary

EDGE = [(1, None), (2, ""), (3, "  \n "), (4, "word"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "x y"), (6, "é日本🙂 ▁ \t z"), (7, "q" * 5000), (8, "one two three. " * 400)]
ODD = ["a", "b", "'s", "'ll", "é", " ", "  ", "\n", ".", ",", "<|endoftext|>", "3", "²", "-", "\t", "日", "\xa0", "(", "|", '!"', "_", "🙂", "A", "▁", "×", "ß", "\x85", "\u2003", "\u3000", "ж", "'", "\r", "%%"]


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def odd_texts(n, seed=5):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 7, 50, 2_000_000])
def test_parts_join_to_the_texts(size):
    import pyarrow as pa

    texts = [None, "", *odd_texts(300), "", "é" * 40, "x" * 90, "", None]
    column = pa.array(["skipped", *texts])[1:]
    joined, over = [b""] * len(texts), [0]
    for part in chunks.segments(column, ["<|endoftext|>"], size):
        for k, t in zip(part.place, part.text):
            joined[t] += part.words[k]
        over.append(part.over)
    assert joined == [(t or "").encode() for t in texts] and over[-1] == len(texts) and over == sorted(over)


def test_counts_and_ids_equal_the_library(bpe, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    counter, encoder, texts = token_counts.Counter(path), token_files.Encoder(path), odd_texts(6000)
    want = [bpe.encode(t, add_special_tokens=False).ids for t in texts]
    assert [counter.whole(t) for t in texts] == [*map(len, want)]
    for size in (20, 2_000_000):
        monkeypatch.setattr(chunks, "SEGMENT", size)
        assert [x.tolist() for x in encoder.encode(texts)] == want
        assert counter.counts(token_files.pa.array(texts)).tolist() == [*map(len, want)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(vocabulary("word_bpe_49k.json"))


def test_token_counts_of_odd_rows(spark, docs, bpe):
    got = token_counts.token_counts(docs(EDGE), vocabulary("byte_bpe_50k.json")).collect()
    want = Tally((i, len((t or "").encode()), len(bpe.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE)
    assert Tally((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(docs([]), vocabulary("byte_bpe_50k.json")).collect() == []


def test_token_files_read_back(spark, docs, bpe, tmp_path):
    path = vocabulary("byte_bpe_50k.json")
    rows = [r for r in EDGE if r[0] is not None] + [(100 + i, t) for i, t in enumerate(odd_texts(300))]
    folder = str(tmp_path / "f")
    manifest = token_files.write_token_files(docs(rows), folder, path, length=16, rows=4).collect()
    got = sorted(token_files.read_token_files(spark, folder).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == sorted(want)
    for m in manifest:  # random access to equal-length rows, only the last one padded
        reader = token_files.SequenceReader(token_files._store(folder)[0], m.file + ".arrow")
        rows_in = -(-m.n_ids // 16)
        whole = np.concatenate([reader.sequence(k)[0] for k in reversed(range(rows_in))][::-1])
        assert len(whole) == 16 * rows_in and not reader.sequence(0)[0].flags.owndata
        assert sum(reader.sequence(k)[1].true_count for k in range(rows_in)) == m.n_ids
    assert token_files.token_files(docs([]), path).collect() == []


def test_fingerprints_of_edited_texts(spark, docs):
    rows = [r for r in EDGE if r[0] is not None and r != (5, "a b c d e f")] + [(5, "a b c d e f"), (50, "one two three. " * 400)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs(rows), buckets=3).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[8].fingerprint == got[50].fingerprint != "" and got[2].fingerprint == got[3].fingerprint == ""
    assert fingerprints.fingerprints(docs([])).collect() == []
    assert [r.near_next for r in fingerprints.fingerprints(docs([(None, "a b"), (None, "c d")])).collect()] == [0.0, 0.0]
    assert [r.near_next for r in fingerprints.fingerprints(docs([(9, "a b")])).collect()] == [1.0]


def test_fingerprints_estimate_generalised_jaccard(spark):
    draw, rows, want = random.Random(1), [], []
    for share in (0.2, 0.5, 0.8):
        for _ in range(40):
            common = [f"w{draw.randint(0, 10**9)}" for _ in range(600)]
            cut = int(600 * share)
            a, b = common, common[:cut] + [f"v{draw.randint(0, 10**9)}" for _ in range(600 - cut)]
            a, b = a + a[:200], b + b[:200]  # repeats, so weights above one
            grams = [Tally(zip(*[x[i:] for i in range(5)])) for x in (a, b)]
            want.append(sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values()))
            rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": fingerprints.signature("a"), "y": fingerprints.signature("b")})
    got = [r.n for r in df.select(fingerprints.likeness("x", "y").alias("n")).collect()]
    for k in range(3):
        part = slice(40 * k, 40 * k + 40)
        assert np.mean(got[part]) == pytest.approx(np.mean(want[part]), abs=0.03)


def test_line_dedup_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(i, "\n".join(draw.choice(["menu", "foot", "", " ", f"u{draw.randint(0, 40)}"]) for _ in range(draw.randint(1, 6))), draw.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "menu\nmenu", "lonely")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, n_lines string").drop("n_lines")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(pages, ratio=0.1).collect()}
    for i, text, host in rows:
        own = [t for _, t, h in rows if h == host]
        if text is None:
            assert got[i].text is None and got[i].n_lines == got[i].n_dropped == 0
            continue
        seen = Tally(x for t in own if t is not None for x in set(t.split("\n")))
        keep = [x for x in text.split("\n") if not (x.strip(" ") and seen[x] >= 3 and seen[x] > 0.1 * len(own))]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == ("\n".join(keep), text.count("\n") + 1, text.count("\n") + 1 - len(keep))
    assert line_dedup.drop_boilerplate(pages.where("false")).collect() == []


def test_fingerprints_weigh_terms_unevenly(spark):
    draw, rows, want = random.Random(3), [], []
    line = "go to the next page now "  # 6 words, so its shingles recur
    for times in (1, 30, 1000):
        for n in (0, 20, 60, 400):
            for shared in (0.0, 0.5, 1.0):
                for more in (1, 3):
                    fresh = [[f"{c}{draw.randint(0, 10**9)}" for _ in range(n)] for c in "uvw"]
                    cut = int(n * shared)
                    a, b = line * times + " ".join(fresh[0]), line * (times * more) + " ".join(fresh[0][:cut] + fresh[1][cut:])
                    grams = [Tally(zip(*[x.split()[i:] for i in range(5)])) for x in (a, b)]
                    want.append(sum((grams[0] & grams[1]).values()) / sum((grams[0] | grams[1]).values()))
                    rows.append((a, b))
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": fingerprints.signature("a"), "y": fingerprints.signature("b")})
    off = np.array([r.n for r in df.select(fingerprints.likeness("x", "y").alias("n")).collect()]) - want
    assert np.abs(off).mean() < 0.03 and np.abs(off).max() < 0.15 and abs(off.mean()) < 0.012


def test_fingerprints_of_rows_without_ids(spark, docs):
    rows = [(None, f"text number {i}") for i in range(40)] + [(i, f"own {i}") for i in range(5)] + [(None, "text number 3")]
    got = fingerprints.fingerprints(docs(rows), buckets=4).collect()
    hashes = {r.t: r.h for r in spark.createDataFrame(sorted({t for _, t in rows}), "string").toDF("t").select("t", fingerprints.F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashes[r[1]] if r[0] is None else 0, r[1]))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        want.append((i, hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()))
    assert Tally((r.doc_id, r.edited_sha256) for r in got) == Tally(want)


def test_line_dedup_passes_any_names_on(spark):
    rows = [(i, f"menu\nown {i}", "h", 1, 2, 3, 4, 5, 6) for i in range(6)]
    names = "doc_id long, text string, source string, _host int, _keys int, line_keys int, host_of_keys int, n_lines int, page_key int"
    pages = spark.createDataFrame(rows, names)
    for got in (line_dedup.drop_boilerplate(pages), line_dedup.drop_passages(pages, min_words=0)):
        assert {(r.doc_id, r.text, r._host, r._keys, r.line_keys, r.host_of_keys, r.page_key, r.n_dropped) for r in got.collect()} == {
            (i, f"own {i}", 1, 2, 3, 4, 6, 1) for i in range(6)
        }


def test_line_dedup_by_salted_join(spark, monkeypatch):
    rows = [(i, f"menu\nown {i}", "h") for i in range(20)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", -1)
    assert sorted((r.doc_id, r.text) for r in line_dedup.drop_boilerplate(pages).collect()) == [(i, f"own {i}") for i in range(20)]


def test_passages_shared_between_hosts_go(spark):
    shared, pair, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 51), ("q", 51), ("r", 50)))
    own = {i: "\n".join([f"own {i}", short, *([shared] if i < 3 else []), *([pair] if i < 2 else [])]) for i in range(5)}
    rows = [(i, t, f"host {i}") for i, t in own.items()] + [(7, None, None), (8, "", None), (None, shared, "h")]
    pages = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_passages(pages).collect()}
    want = {i: (t.replace("\n" + shared, ""), int(i < 3)) for i, t in own.items()} | {7: (None, 0), 8: ("", 0), None: ("", 1)}
    assert got == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def test_base_spans_equal_the_patterns():
    draw = random.Random(1)
    for k in range(9000):
        if k % 3:
            x = "".join(draw.choice("a1.@-_+ 2()") for _ in range(draw.randint(0, 30)))
        else:  # long runs of digits, some of which pass Luhn
            x = "".join(draw.choice(["4111", "1111", "0", "9", " ", "-", "+", "5500000000000004", "(5)"]) for _ in range(draw.randint(0, 14)))
        got = pii.base_spans(x)
        digits = [(m.span(), re.sub("[^0-9]", "", m[0])) for m in CARD.finditer(x)]
        calls = [(m.span(), re.sub("[^0-9]", "", m[0])) for m in PHONE.finditer(x)]
        assert [s[1:] for s in got if s[0] == "email"] == [m.span() for m in EMAIL.finditer(x)]
        assert [s[1:] for s in got if s[0] == "ip"] == [m.span() for m in IP.finditer(x) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s[1:] for s in got if s[0] == "card"] == [at for at, d in digits if 16 <= len(d) <= 19 and luhn(d)]
        assert [s[1:] for s in got if s[0] == "phone"] == [at for at, d in calls if 8 <= len(d) <= 15]


def test_viterbi_finds_the_best_of_all_paths():
    field = pii.trained()
    for text in ("call (555) 492", "4111 / 1111 x", "10 . 20 . 30", "a at b dot"):
        tokens = pii.tokenize(text)[:5]
        e = field.scores(pii.Coded(field.shapes, [tokens]))
        first = pii.legal()[0]
        paths = np.array(np.meshgrid(*[range(len(pii.LABELS))] * len(tokens), indexing="ij")).reshape(len(tokens), -1).T
        total = first[paths[:, 0]] + sum(e[k, paths[:, k]] for k in range(len(tokens))) + sum(field.moves[paths[:, k], paths[:, k + 1]] for k in range(len(tokens) - 1))
        assert field.decode([tokens])[0].tolist() == paths[total.argmax()].tolist()


def test_gradient_of_the_field_is_that_of_the_likelihood():
    rows = [("call (555) 4", [("phone", 5, 12)]), ("x 1", [])]
    field = pii.Field.fit(rows, epochs=200, l2=0.0)
    for text, spans in rows:  # with nothing to hold it back, training makes the labels of the table nearly certain
        tokens = pii.tokenize(text)
        e, first = field.scores(pii.Coded(field.shapes, [tokens])), pii.legal()[0]
        paths = np.array(np.meshgrid(*[range(len(pii.LABELS))] * len(tokens), indexing="ij")).reshape(len(tokens), -1).T
        total = first[paths[:, 0]] + sum(e[k, paths[:, k]] for k in range(len(tokens))) + sum(field.moves[paths[:, k], paths[:, k + 1]] for k in range(len(tokens) - 1))
        best = paths[total.argmax()].tolist()
        assert best == ([0, *([7, 8, 8, 8] if spans else [])] + [0])[: len(tokens)]
        assert np.exp(total.max() - np.logaddexp.reduce(total)) > 0.9


def by_kind(rows):
    """(precision, recall) of the added spans by kind."""
    hit, made, true = Tally(), Tally(), Tally()
    for (_, spans), (base, every) in zip(rows, pii.find([t for t, _ in rows], pii.trained())):
        made.update(k for k, *_ in set(every) - set(base))
        true.update(k for k, *_ in spans)
        hit.update(k for k, *_ in set(every) & set(spans))
    return {k: (hit[k] / made[k], hit[k] / true[k]) for k in pii.KINDS}


def test_the_field_finds_spellings_it_was_not_trained_on(spark, sf_dir):
    assert all(min(v) >= 0.97 for v in by_kind(pii.labelled(seed=99, copies=10)).values())  # other names and numbers
    around = {  # other surroundings
        "email": ["W w w w S w, w", "for w ask S (w)", "w: S | w", "drop S a line", "drop a line at S."],
        "ip": ["w S w W", "the w machine is S.", "route to S via w"], "card": ["W w w. S w w", "number S valid until ##/##", "billed S twice"],
        "phone": ["W. w w S w w", "dial S please", "text S, w w", "our office: tel. S, w"],
    }
    plain = ["W w w #### w w, w #-#", "w ## w ## w ### w", "on ##.##.#### at ##:## w", "a ### by ### w", "W. ###.###.### w", "#### #### w w"]
    assert all(min(v) >= 0.9 for v in by_kind(pii.labelled(seed=5, copies=10, around=around, texts=plain)).values())
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    assert all(every == base for base, every in pii.find(texts, pii.trained()))  # nothing is found where nothing was written
    draw, rows = random.Random(8), []
    for k, text in enumerate(texts):  # spellings put between the words of documents
        kind = pii.KINDS[k % 4]
        at, span = text.find(" ", draw.randrange(len(text))) + 1, pii.spell(draw, draw.choice(pii.SPELLINGS[kind]))
        rows.append((text[:at] + span + " " + text[at:], [(kind, at, at + len(span))]))
    assert all(min(v) >= 0.9 for v in by_kind(rows).values())


def test_long_windows_are_decoded_in_pieces(monkeypatch):
    draw, field = random.Random(2), pii.trained()
    rows = pii.labelled(seed=3, copies=12)
    draw.shuffle(rows)
    tokens = pii.tokenize(" ".join(t for t, _ in rows))
    assert len(tokens) > 20 * pii.MOST
    pieces, whole = field.labels([tokens])[0], field.decode([tokens])[0]
    assert len(pieces) == len(tokens) and (pieces == whole).mean() > 0.999


def test_a_long_text_of_numbers_takes_bounded_memory():
    import subprocess
    import sys

    code = "import resource; from weir.llm import pii; f = pii.trained(); a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; x = ','.join(str(i * 7919 % 1000) for i in range(1300000)); pii.find([x, *['a 1'] * 255], f); print(len(x), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=str(__import__("pathlib").Path(__file__).resolve().parents[2]))
    size, grown = map(int, done.stdout.split())
    assert size > 5_000_000 and grown < 150_000  # kB


def test_pii_of_odd_rows(spark, docs):
    rows = EDGE + [(20, "write a.b@mail.example.com or +1 (555) 492-1092, from 10.0.0.1 card 4111 1111 1111 1111"), (21, "reach anna (at) example (dot) com")]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows)).collect()}
    assert (got[20].n_email, got[20].n_ip, got[20].n_card, got[20].n_phone) == (1, 1, 1, 1)
    assert got[20].spans.startswith("email:6:26,ip:") and got[21].n_email == 0 and got[21].spans == "email:6:33"
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(docs([])).collect() == []


def test_licenses(spark, docs):
    rows = EDGE + [
        (30, "aa bb\nLicensed under the Apache License, Version 2.0.\ncc"), (31, "the license of a poet is not a license"),
        (32, "This work is licenced under the GNU General Public License, version 3."), (33, "Released under the MIT License"), (34, licenses.TEXTS["ISC"][0]),
        (35, "Licensed under the Apache License, Version 3.0."),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(rows)).collect()}
    assert {k: r.license for k, r in got.items()} == {30: "Apache-2.0", 32: "GPL-3.0", 33: "MIT", 34: "ISC"}
    assert (got[30].block_start, got[30].block_end, got[30].n_diff) == (6, 53, 0) and got[32].wording == "-licensed +licenced"
    assert licenses.scan_licenses(docs([])).collect() == []
    long = "w " * 9000 + "Released under the MIT License. " + "v " * 9000
    assert [r[2] for r in licenses.Scanner().scan(long)] == ["MIT"]


PROSE = "The river bends twice before it meets the old mill, and the people of the valley walk there on quiet evenings to talk. "


def test_licenses_are_found_within_prose():
    scanner = licenses.Scanner()
    for before, after in ((0, 1), (1, 1), (3, 3), (40, 0), (60, 60)):  # from one sentence on the line to a very long line
        text = PROSE * before + "Released under the MIT License. " + PROSE * after
        at = len(PROSE) * before
        assert [r[:3] + r[4:] for r in scanner.scan(text)] == [(at, at + 31, "MIT", 0, "")]
    assert scanner.scan(PROSE * 3 + "the license of a poet is not a license " + PROSE * 3) == []
    for k in licenses.NAMES:  # every notice with license language, between prose and over a line's end
        for notice in licenses.notices(k):
            if licenses._ANCHOR.search(notice):
                assert k in [r[2] for r in scanner.scan(PROSE + notice.replace(" ", "\n", 1) + " " + PROSE)], notice


def wrapped(text, width=70):
    import textwrap

    return "\n".join(textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


def test_published_wordings():
    scanner = licenses.Scanner()
    for k, texts in licenses.TEXTS.items():
        for text in (texts[-1], wrapped(texts[-1]), PROSE + "\n\n" + wrapped(texts[-1], 40) + "\n\n" + PROSE):
            got = scanner.scan(text)
            assert [r[2] for r in got] == [k] and got[0][4] == 0, (k, got)
    mit = licenses.TEXTS["MIT"][1]
    paragraphs = mit.replace("conditions: The above", "conditions:\n\nThe above").replace("Software. THE", "Software.\n\nTHE")
    assert [r[2:5:2] for r in scanner.scan("MIT-like\n\nCopyright (c) 2020 A. Writer\n\n" + paragraphs)] == [("MIT", 0)]
    two, three = licenses.TEXTS["BSD-2-Clause"][2], licenses.TEXTS["BSD-3-Clause"][1]
    named = three.replace("the copyright holder nor", "Example Software Ltd. nor")
    starred = re.sub(r"\b[123]\. ", "* ", three)
    for text, want in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (named, "BSD-3-Clause"), (starred, "BSD-3-Clause")):
        assert [r[2] for r in scanner.scan(wrapped(text))] == [want]


def test_places_of_notices_against_brute_force():
    def costs(notice, block):
        """Least cost of the notice against words of the block that end at each place."""
        rows = [[0] * (len(block) + 1)]
        for i, (w, fixed) in enumerate(zip(notice.words, notice.fixed), 1):
            lost = notice.never if fixed else 1
            rows.append([rows[-1][0] + lost])
            for j, x in enumerate(block, 1):
                rows[i].append(min(rows[i - 1][j - 1] + (0 if w == x else lost), rows[i - 1][j] + lost, rows[i][j - 1] + 1))
        return rows[-1]

    scanner, draw = licenses.Scanner(), random.Random(4)
    for _ in range(40):
        own = licenses.words(PROSE)[: draw.randint(0, 12)]
        for notice in draw.sample(scanner.notices, 2):
            words = list(notice.words)[:60]
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(["word", "license", "the"])
            own += words + licenses.words(PROSE)[: draw.randint(0, 5)]
        want = set()
        for notice in scanner.notices:
            found = costs(notice, own)
            if min(found) <= notice.allowed:
                want.add((notice.license, tuple(notice.words), min(found)))
        got = {}
        for cost, _, _, _, notice in scanner.accepted(own):
            key = notice.license, tuple(notice.words)
            got[key] = min(cost, got.get(key, cost))
        assert {(*k, v) for k, v in got.items()} == want


def test_compression_finds_and_ranks_licenses():
    """A license whose template is taken away isn't found, and loses places to others; no notice that is left is lost."""
    text, three = PROSE + "Released under the MIT License. Licensed under the ISC License. " + PROSE, licenses.TEXTS["BSD-3-Clause"][1]
    scanner = licenses.Scanner()
    assert [r[2] for r in scanner.scan(text)] == ["MIT", "ISC"] and [r[2] for r in scanner.scan(three)] == ["BSD-3-Clause"]
    scanner.given["MIT"] = scanner.given["BSD-3-Clause"] = scanner.alone
    assert [r[2] for r in scanner.scan(text)] == ["ISC"] and [r[2] for r in scanner.scan(three)] == ["BSD-2-Clause"]
    scanner = licenses.Scanner()
    for short in ("licensed the mit license a", "of released as the mit license international commons made eclipse", "SOFTWARE RELEASED\n\tUNDER OF THE MIT LICENSE"):
        assert [r[2] for r in scanner.scan(short)] == ["MIT"]


def test_every_license_of_a_text_is_reported():
    two = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    tags = ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0"]
    for pair in (two, tags):
        for between in ("\n", " ", " or ", "\n\n"):
            text = pair[0] + between + pair[1]
            at = len(pair[0] + between)
            assert [r[:3] for r in licenses.Scanner().scan(text)] == [(0, len(pair[0]), "MIT"), (at, len(text), "Apache-2.0")]
    names = [licenses.FORMS[2].format(v[0]) for v in licenses.NAMES.values()]
    assert [r[2] for r in licenses.Scanner().scan(PROSE + " ".join(names * 3) + " " + PROSE)] == list(licenses.NAMES) * 3


def test_piece_sampling_round_trip_and_repeatability(spark, docs):
    model, rows = vocabulary("piece_bpe_32k.model"), EDGE + [(200 + i, t) for i, t in enumerate(odd_texts(200, 9))]
    once = piece_sampling.decode(piece_sampling.encode(docs(rows), model), model).collect()
    assert all(r.decoded == (r.text or "") for r in once)
    again = piece_sampling.encode(docs(rows[::-1]).repartition(5), model).collect()
    assert Tally((r.doc_id, r.text, tuple(r.ids)) for r in once) == Tally((r.doc_id, r.text, tuple(r.ids)) for r in again)
    other = piece_sampling.encode(docs(rows), model, seed=1).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in other} != {(r.doc_id, tuple(r.ids)) for r in once}
    assert piece_sampling.encode(docs([]), model).collect() == []


def test_piece_sampling_goes_by_the_text_alone(monkeypatch):
    own, texts = piece_sampling.Lattices(vocabulary("piece_bpe_32k.model"), 1.0), [None, *odd_texts(400, 11), "", "\na", "x\n", "\nb c. d"]
    seeds = piece_sampling.mix(np.arange(len(texts), dtype=np.uint64))

    def drawn(order):
        ids, offsets = own.sample(piece_sampling.pa.array([texts[k] for k in order]), seeds[order])
        return dict(zip(order, (x.tolist() for x in np.split(ids, offsets[1:-1]))))

    whole = drawn([*range(len(texts))])
    assert all(own.vocabulary.decode(v) == (texts[k] or "") for k, v in whole.items())
    own.clear()
    for size in (3, 40):  # segments end anywhere
        monkeypatch.setattr(piece_sampling, "SEGMENT", size)
        assert drawn([*range(len(texts))][::-1]) == whole


def test_no_piece_holds_a_place_where_texts_are_cut():
    own = piece_sampling.Vocabulary(vocabulary("piece_bpe_32k.model"))
    for piece in own.weight:
        spelt = np.frombuffer(piece.replace(piece_sampling.MARK, " ").encode(), np.uint8)
        assert not own.cut(spelt, None).any(), piece


def test_piece_sampling_draws_by_weight():
    own = piece_sampling.Lattices(vocabulary("piece_bpe_32k.model"), 1.0)
    pieces, s = own.vocabulary.weight, piece_sampling.MARK + "hello"

    def ways(at):
        if at == len(s):
            yield (), 0.0
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in pieces:
                i, w = pieces[s[at:end]]
                for rest, more in ways(end):
                    yield (i, *rest), w + more

    chance = {k: math.exp(w) for k, w in ways(0)}
    whole, n = sum(chance.values()), 20_000
    ids, offsets = own.sample(piece_sampling.pa.array(["hello"] * n), np.arange(n, dtype=np.uint64) * np.uint64(7919))
    got = Tally(tuple(x.tolist()) for x in np.split(ids, offsets[1:-1]))
    assert set(got) <= set(chance)
    for k, v in chance.items():
        assert got[k] / n == pytest.approx(v / whole, abs=0.015)


def test_myers_distance_against_dynamic_programming():
    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
            row = new
        return min(row), row.index(min(row))

    draw = random.Random(3)
    for _ in range(500):
        p = "".join(draw.choice("abc") for _ in range(draw.randint(1, 80)))
        t = "".join(draw.choice("abc") for _ in range(draw.randint(0, 60)))
        d, end = decontamination.least_distance(decontamination.letters(p), len(p), t)
        want = plain(p, t)
        assert d == want[0] and (d == len(p) or end == want[1])


def test_decontamination_finds_edited_passages(spark, docs):
    draw = random.Random(4)
    items = [(k, " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(30))) for k in range(6)] + [(90, None), (91, "short")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows, want = list(EDGE), set()
    for k, item in items[:6]:
        edited = list(item)
        for at in draw.sample(range(len(edited)), 4):
            edited[at] = "z"
        far = "".join("z" if n % 6 == 0 else c for n, c in enumerate(item))
        rows += [(100 + k, f"before {item.upper()}  after"), (200 + k, "x " + "".join(edited)), (300 + k, far)]
        want |= {(100 + k, k, 0), (200 + k, k, 4)}
    for block in (decontamination.BLOCK_CHARS, 200):  # one block, then many
        got = decontamination.matches(docs(rows), benchmark, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want
    kept = decontamination.without_leaks(docs(rows), benchmark)
    assert kept.count() == len(rows) - 12 and kept.columns == docs([]).columns
    assert decontamination.matches(docs(rows), benchmark.where("false")).collect() == []
    assert decontamination.matches(docs([]), benchmark).collect() == []


def test_leaks_go_by_row(spark):
    item = "who wrote the long poem of the sea and of the journey home, in the old tongue?"
    rows = [(None, f"q: {item}", 1), (5, f"x {item} y", 2), (5, "clean", 3), (None, None, 4)]
    made = spark.createDataFrame(rows, "doc_id long, text string, n int")
    benchmark = spark.createDataFrame([(1, item), (2, "another item that is nowhere to be found in it"), (None, None)], "item_id long, text string")
    for block in (decontamination.BLOCK_CHARS, 50):
        assert sorted(r.n for r in decontamination.without_leaks(made, benchmark, block_chars=block).collect()) == [3, 4]
    assert decontamination.without_leaks(made, benchmark.where("false")).count() == 4


def test_short_items_match_at_word_edges(spark, docs):
    items = [(1, "Paris"), (2, "who wrote the odyssey?"), (3, "東京"), (4, ""), (5, "42")]
    rows = [
        (1, "in paris,  France"), (2, "a comparison of parishes"), (3, "Q: Who  wrote the\nOdyssey? A: Homer"), (4, "who wrotte the odyssey?"),
        (5, "who wrotte thee odyssey?"), (6, "我在東京住"), (7, "it is 42."), (8, "it is 1423"), (9, "xwho wrote the odyssey? paris"), (10, None), (11, "parisparis paris"),
    ]
    got = decontamination.matches(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(1, 1, 0, 8), (3, 2, 0, 25), (4, 2, 1, 23), (6, 3, 0, 4), (7, 5, 0, 8), (9, 1, 0, 29), (9, 2, 1, 23), (11, 1, 0, 16)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_toxicity_learns_words_and_scores_odd_rows(spark, docs):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(500):
        body = [draw.choice(words) for _ in range(draw.randint(20, 120))]
        if i % 5 == 0:
            for w in draw.sample(["vileword", "scumbagz", "mudlark", "foulness"], 3):
                body.insert(draw.randrange(len(body)), w)
        rows.append((i, " ".join(body)))
        marks.append((i, 1, int(i % 5 == 0)))
    labels = spark.createDataFrame(marks + [(None, 1, 1), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs(rows), labels.where(~toxicity.held_out("doc_id")))
    got = toxicity.score(docs(rows + [(1000 + k, t) for k, (_, t) in enumerate(EDGE)]), model).withColumn("out", toxicity.held_out("doc_id")).collect()
    held = [(r.predicted, int(r.doc_id % 5 == 0)) for r in got if r.out and r.doc_id < 500]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = toxicity.train(docs(rows), labels.where("false"))
    assert {r.score for r in toxicity.score(docs(rows[:3]), none).collect()} == {0.0}
    assert toxicity.score(docs([]), model).collect() == []


def test_a_long_text_does_not_end_the_toxicity_sample(spark, docs, monkeypatch):
    rows = [(i, f"vile scum {i}" if i % 2 else f"calm sea {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    order = [r.id for r in spark.range(60).orderBy(toxicity.F.xxhash64("id")).collect()]
    seen = []
    monkeypatch.setattr(toxicity.Model, "fit", classmethod(lambda cls, rows, y, share: seen.append(Tally(y.tolist()))))
    for size in (700, 5000):  # beyond a tenth of the budget, beyond all of it
        long = [(i, t + " filler" * (size // 7) if i in [next(x for x in order if x % 2 == c) for c in (0, 1)] else t) for i, t in rows]
        toxicity.train(docs(long), labels, chars=(1000, 1000))
    assert seen[0] == seen[1] == {0: 29, 1: 29}
    toxicity.train(docs([(1, "vile " * 900), (2, "calm " * 900)]), labels, chars=(1000, 1000))
    assert seen[2] == {0: 1, 1: 1}
    with pytest.raises(ValueError):
        toxicity.train(docs([(i, t) for i, t in rows if i % 2]), labels, sample=(10, 10))


def test_held_out_rows(spark):
    got = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
