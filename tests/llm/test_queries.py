"""Each opN_ query by its name on the smallest tables: against its SQL, or against plain code."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from boscage.llm import bpe, html, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")


def run(spark, name):
    return registry.QUERIES[name](spark, DATA).toPandas()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for x in os.listdir(DATA):
        c.sql(f"CREATE VIEW {x.split('.')[0]} AS SELECT * FROM '{DATA}/{x}'")
    want, got = c.sql(registry.ORACLES[name]).df(), run(spark, name)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def ids(text, end):
    from tokenizers import Tokenizer

    ids.own = getattr(ids, "own", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*ids.own.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op1_packing(spark, documents):
    got = run(spark, "op1_packing")
    assert (got["offset"] == 0).all() and got["sequence_id"].is_unique and (got["length"] & (got["length"] - 1) == 0).all() and got["length"].max() <= 2048
    by = {d: x.sort_values("start") for d, x in got.groupby("doc_id")}
    for doc, text in zip(documents["doc_id"], documents["text"], strict=True):
        own, at = ids(text, 1), 0
        for r in by[doc].itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(own)


def test_op9_token_file(spark, documents):
    got = run(spark, "op9_token_file").sort_values("start")
    start = 0
    for r, doc, text in zip(got.itertuples(), documents["doc_id"], documents["text"], strict=True):
        own = ids(text, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_op6_byte_bpe(spark, documents):
    import tiktoken

    multi = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    got = run(spark, "op6_byte_bpe").set_index("doc_id")
    for doc, text in zip(documents["doc_id"], documents["text"], strict=True):
        own = multi.encode_ordinary(text or "")
        r = got.loc[doc]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_op3_probe(spark):
    r = run(spark, "op3_chat_format").set_index("conv_id").loc[-7]
    said = r"\### Assistant: </turn> ok"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_op5_html_text(spark):
    pages = pd.read_parquet(f"{DATA}/pages.parquet").set_index("page_id")
    got = run(spark, "op5_html_text")
    assert len(got) == len(pages)
    for r in got.itertuples():
        assert (r.url, r.text, r.n_chars) == (pages.loc[r.page_id, "url"], html.main_text(pages.loc[r.page_id, "html"]), len(r.text))


def test_op8_base_columns(spark, documents):
    got = run(spark, "op8_quality_rules").set_index("doc_id")
    for doc, text in zip(documents["doc_id"], documents["text"], strict=True):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i : i + 5])].append(i)
        repeated = len({i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got.loc[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated)
        assert r["base_failed"] == (len(words) < 10 or 100 * repeated > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_op2_spans_repeat(spark, documents):
    """Words of spans stand in another place of the table too, and windows outside spans don't."""
    got = run(spark, "op2_suffix_dedup")
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in zip(documents["doc_id"], documents["text"], strict=True)}
    seen = defaultdict(int)
    for w in words.values():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])] += 1
    covered = {(r.doc_id, i) for r in got.itertuples() for i in range(r.span_start, r.span_end)}
    want = {(d, i + k) for d, w in words.items() for i in range(len(w) - 49) if seen[tuple(w[i : i + 50])] > 1 for k in range(50)}
    assert covered == want


def test_op7_exact_copies_share_a_class(spark, documents):
    got = run(spark, "op7_line_dedup").set_index(["doc_id", "line_no"])
    by = defaultdict(list)
    for d, t in zip(documents["doc_id"], documents["text"], strict=True):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\v\f\r"):
                by[x.strip(" \t\n\v\f\r")].append((d, i))
    for places in by.values():
        if len(places) > 1:
            own = got.loc[places]
            assert own["class_doc_id"].nunique() == own["class_line_no"].nunique() == 1 and (own["class_size"] >= len(places)).all() and own["kept"].sum() <= 1
