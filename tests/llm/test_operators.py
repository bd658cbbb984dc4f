"""Operators against brute force, and on odd tables."""

import glob
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stemma.llm import decontaminate, html_text, minhash_dedup, quality_gam, quality_rules, queries, secret_scan, sentencepiece_codec, suffix_dedup, token_counts, token_output
from stemma.llm.sentencepiece_codec import MARK

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG = (1 << 53) + 1
ODD = [None, "", " ", "\n\n", "  two  spaces ", "a.b,c", "é日本 ﬁ", "tab\there\r\nline", "<|endoftext|> <s> ▁x", "​́", "😀" * 3, "x" * 3000, "long text " * 3000]


def texts(n=300):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", ".", ",", "...", "a", "Hello", "é", "日本", " ", "'s", "\t", "12", "<|endoftext|>", "😀", "_", "▁", "<0x41>", "\x00", "́"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(n)]


def words_df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


OPERATORS = {
    "quality_rules": lambda df: quality_rules.measured(df),
    "token_counts": lambda df: token_counts.count_tokens(df, PIECES),
    "quality_gam": lambda df: quality_gam.score(df, quality_gam.fit(np.zeros((0, 13)), np.zeros(0))),
    "secret_scan": lambda df: secret_scan.find_secrets(df),
    "redact": lambda df: secret_scan.redact_secrets(df),
    "html_text": lambda df: html_text.extract_text(df, "text"),
    "sentencepiece": lambda df: sentencepiece_codec.encode_pieces(df, PIECES),
    "minhash": lambda df: minhash_dedup.near_duplicates(df),
    "deduplicate": lambda df: minhash_dedup.deduplicate(df),
    "suffix": lambda df: suffix_dedup.remove_repeats(df),
    "tokens": lambda df: token_output.encode_table(df, BPE, 2),
    "decontaminate": lambda df: decontaminate.verdicts(df, df.sparkSession.createDataFrame([(1, "an item of words that no text has")], "item_id long, text string")),
}
#: Columns of the input that operators give back.
KEPT = {"quality_rules", "token_counts", "quality_gam", "secret_scan", "redact", "html_text", "sentencepiece"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    clashing = "words row text_length kept n score ids id size h lanes seq label spans".split()
    rows = [(BIG + i, t, None if i % 2 else BIG, *["c"] * len(clashing)) for i, t in enumerate(ODD)]
    rows += [(None, "a null id", None, *["c"] * len(clashing)), rows[5], rows[5]]
    own = {"quality_rules": ["kept"], "quality_gam": ["score"], "secret_scan": ["spans"], "sentencepiece": ["ids"]}.get(name, [])
    df = spark.createDataFrame(rows, "doc_id long, text string, other long, " + ", ".join(f"{c} string" for c in clashing)).repartition(2)
    got = OPERATORS[name](df).collect()
    if name == "deduplicate":
        assert BIG + 5 in {r.doc_id for r in got} and None in {r.doc_id for r in got}
    else:
        assert sorted((r.doc_id or 0) for r in got) == sorted((r[0] or 0) for r in rows)
    if name in KEPT:
        assert sorted((r.other or 0) for r in got) == sorted((r[2] or 0) for r in rows)
        assert all(r[c] == "c" for r in got for c in clashing if c not in own)
    empty = OPERATORS[name](df.limit(0))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](df).columns


def test_rules_equal_brute_force(spark):
    many = texts() + ["one two three " * 40, "# $ | " * 30, "A\nA\nB\nA", " ".join(f"w{i}" for i in range(60))]
    got = {r.doc_id: r for r in quality_rules.measured(words_df(spark, list(enumerate(many)))).collect()}
    for i, text in enumerate(many):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)} if len(words) < 2000 else None
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines))]
        assert [got[i][c] for c in quality_rules.BASE[:4]] == want
        if repeated is not None:
            assert got[i].n_repeat_words == len(repeated) and got[i].base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_counts_equal_a_plain_search():
    counter = token_counts.counter(PIECES)
    rng = random.Random(2)
    words = sorted({w for t in texts() if t for w in re.findall(r"[^\x20\x09-\x0D]+", t) if len(w) < 40} | {"".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randrange(1, 14))) for _ in range(300)})
    counter.forget()
    counter.learn(words[::2])
    counter.learn(words[1::2])  # prefixes that the trie has by now
    for word in words:
        path = MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(path) + 1):
            n = len(path[end - 1].encode())
            options = [(best[end - 1][0] + n * counter.unknown, -(best[end - 1][1] + n))]
            options += [(best[s][0] + counter.scores[path[s:end]], -(best[s][1] + 1)) for s in range(end) if path[s:end] in counter.scores]
            score, minus = max(options)
            best.append((score, -minus))
        assert counter.counts[word] == best[-1][1], word


def test_token_ids_equal_the_library(spark):
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    rows = list(enumerate(texts()))
    got = {r.doc_id: list(r.ids) for r in token_output.encode_table(words_df(spark, rows), BPE, 2).collect()}
    want = tok.encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    assert got == {i: [*w.ids, 2] for (i, _), w in zip(rows, want, strict=True)}


def test_token_files(spark, tmp_path):
    tok = Tokenizer.from_file(BPE)
    tok.encode_special_tokens = True
    start, want = 0, {}
    for i, t in documents(spark):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = queries.op5_token_output(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)
    path = f"{tmp_path}/tokens"
    token_output.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), f"file://{path}", BPE, 2, token_output.OPTIONS | {"parquet.block.size": "65536", "parquet.page.size": "8192"})
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in glob.glob(f"{path}/*.parquet") for k in range(pq.ParquetFile(f).num_row_groups)]
    for group in groups:
        columns = {c.path_in_schema: c for c in map(group.column, range(group.num_columns))}
        ids = next(c for n, c in columns.items() if n.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_column_index and ids.has_offset_index
        assert any(e.startswith("DELTA") or "DICTIONARY" in e for e in columns["doc_id"].encodings)


def test_pieces_are_the_tokenizers_library_s_and_have_parity(spark, monkeypatch):
    peer = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = list(enumerate(texts()))
    out = sentencepiece_codec.encode_pieces(words_df(spark, rows), PIECES)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        assert list(got[i].ids) == peer.encode(t or "") and got[i].parity and got[i].n_pieces == len(got[i].ids)
        assert got[i].ids_crc32 == zlib.crc32(np.array(got[i].ids, "<u4").tobytes())
        assert got[i].round_trip or MARK in t or "�" in t
    decoded = {r.doc_id: r.text for r in sentencepiece_codec.decode_pieces(out.select("doc_id", "ids"), PIECES).collect()}
    assert all(decoded[i] == (t or "") for i, t in rows if got[i].round_trip)
    codec = sentencepiece_codec.Codec(PIECES)
    monkeypatch.setattr(codec.encoder, "joined", lambda strings: [[5] * len(s.encode()) for s in strings])
    ids, _, differ = codec.encode(["some words that are new"])
    assert ids.tolist() != peer.encode("some words that are new") and differ.all()  # without the library's ids there are no others


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op4_quality_gam(spark, sf).where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc >= 0.97 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_classifier_without_labels(spark):
    docs = words_df(spark, [(1, "some text"), (2, None)])
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        assert {r.score for r in quality_gam.score(docs, quality_gam.train(docs, given)).collect()} == {0.5}
    one = quality_gam.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in quality_gam.score(docs, one).collect())


def independent_spans(text):
    """Base spans by patterns written anew."""
    out = []
    i = 0
    names = ("password", "passwd", "secret", "token", "api_key", "apikey")
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    while i < len(text):
        for n in names:
            if lower.startswith(n, i):
                j = i + len(n)
                j += text[j : j + 1] in ('"', "'") and bool(text[j : j + 1])
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                sign = j
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and bool(text[j : j + 1])
                k = j
                while text[k : k + 1] in value and text[k : k + 1]:
                    k += 1
                if k > j and sign:
                    if k - j >= 8:
                        out.append((i, 0, k))
                    i = k - 1
                    break
        i += 1
    for kind, start, alphabet, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "", "0123456789abcdef", 32)):
        i = 0
        while i < len(text):
            k = i + len(start)
            while text.startswith(start, i) and text[k : k + 1] and text[k] in alphabet:
                k += 1
            if text.startswith(start, i) and k > i + len(start):
                if k - i >= least:
                    out.append((i, kind, k))
                i = k
            else:
                i += 1
    return sorted(out)


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(3)
    parts = ["password", "API_KEY", "apikey", "secret", "Token", ": ", "=", " = ", "'", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef" * 4, "0f", " ", "\n", "x", "hunter2hunter2", "é", "-_/.+="]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2000)]
    for text in [t or "" for _, t in documents(spark)] + made:
        assert secret_scan.base_spans(text) == independent_spans(text), text


def test_surges_and_dives_decide(monkeypatch):
    body = "This is a sentence of the body, which is long enough to be one. " * 3
    menu = "<nav>" + "".join(f"<div>menu {i}</div>" for i in range(4)) + "</nav>"
    page = f"<body>{menu}<div>{body}</div><div>{body}</div>{menu}<p>Closing words.</p>{menu}<p>Far below.</p></body>"
    weights = [w for *_, w in html_text.lines(page)]
    half = html_text.WINDOW // 2
    sums = [sum(weights[max(0, i - half) : i + half + 1]) for i in range(len(weights))]
    assert sum(b > 0 and not a for a, b in zip([0, *sums], sums, strict=False)) == 3  # surges
    base = html_text.main_text(page)
    assert base.endswith("Closing words.")
    monkeypatch.setattr(html_text, "SHARE", 0.0)
    assert html_text.main_text(page) == base + "\nFar below."
    monkeypatch.setattr(html_text, "WINDOW", 11)
    assert html_text.main_text(page) == base + "\nFar below."


def test_items_may_have_names_as_ids(spark):
    item = "what is the longest river that flows through the old town of the north"
    df = words_df(spark, [(BIG, item), (2, "nothing of the kind"), (None, item)])
    bench = spark.createDataFrame([("b", item), ("a", item), (None, item)], "item_id string, text string")
    rows = {r.doc_id: (r.n_items, r.item_id, r.contaminated) for r in decontaminate.verdicts(df, bench).collect()}
    assert rows == {BIG: (2, "a", True), 2: (0, None, False), None: (0, None, False)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    tables = duckdb.connect()
    for table in ("documents", "benchmark"):
        tables.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = tables.execute(queries.oracle_sql()[name]).fetchdf()
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = [[[None if pd.isna(v) else v for v in r] for r in df[sorted(df.columns)].sort_values("doc_id").values.tolist()] for df in (found.toPandas(), wanted)]
    assert rows[0] == rows[1]


def test_known_segments_stay_in_arrow():
    """Of texts whose segments are known no string is made; cuts lie at spaces and breaks, a sliced array's among them."""
    encoder, tok = token_output.byte_level_encoder.__wrapped__(BPE), Tokenizer.from_file(BPE)
    sliced = pa.array(["x", None, "", " ", ".a. b", " a  b", "\n.", "Ein Wort,noch eins.\n\nUnd 3.5 é日本 ", "a b"]).slice(1)
    made, spelled = [], encoder._spelled
    encoder._spelled = lambda found: made.append(len(found)) or spelled(found)
    for _ in range(2):
        ids, sizes, _ = encoder.encode(sliced)
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in sliced.to_pylist()]
        assert sizes.tolist() == [*map(len, want)] and ids.tolist() == [i for x in want for i in x]
    assert made == [len(encoder.keys)]
