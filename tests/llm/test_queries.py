"""The pipeline, and the operators on odd rows."""

import re

import pytest

import corpus_pipeline
from tests.conftest import SF_DIR
from tideline.llm import workload
from tideline.llm.catalog import QUERIES
from tideline.llm.exact import exact_duplicates
from tideline.llm.leaks import decontaminate, find_leaks
from tideline.llm.lines import dedup_lines, line_report
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.quality import keep_good, quality_scores
from tideline.llm.sentence_pieces import decode, encode
from tideline.llm.substrings import remove_repeats
from tideline.llm.surrogates import replace_personal_data
from tideline.llm.token_counts import token_counts
from tideline.llm.training_order import read_ranks, read_slots, write_training_order

MODEL = workload.tokenizer("piece_bpe_32k.model")
WORDS = workload.tokenizer("word_bpe_49k.json")


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_pipeline_keeps_columns_and_round_trip(spark):
    docs = workload.table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialise(stage(spark, docs, SF_DIR))
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.where("not round_trip").isEmpty() and last.count() == docs.count()


def operators(spark, tmp):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "beta gamma"), (None, None), (2, "")], "item_id long, text string")
    ranks = read_ranks(workload.tokenizer("byte_bpe_50k.tiktoken"), workload.SPLIT_PATTERN)
    return {
        "quality": lambda d: quality_scores(d, labels),
        "good": lambda d: keep_good(d, labels),
        "exact": exact_duplicates,
        "order": lambda d: write_training_order(d, f"{tmp}/shards", ranks, 50256, b"k")[1],
        "lines": dedup_lines,
        "surrogates": lambda d: replace_personal_data(d, b"k"),
        "pieces": lambda d: decode(encode(d, MODEL), MODEL),
        "repeats": lambda d: remove_repeats(d, 50),
        "join": near_duplicates,
        "counts": lambda d: token_counts(d, WORDS),
        "leaks": lambda d: decontaminate(d, bench),
    }


NAMES = "quality good exact order lines surrogates pieces repeats join counts leaks".split()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table_and_odd_rows(spark, odd, tmp_path, name):
    run = operators(spark, tmp_path / "a")[name]
    assert run(odd.limit(0)).collect() == []
    run = operators(spark, tmp_path / "b")[name]
    n = run(odd).count()
    assert n == 10 if name not in ("good", "order", "leaks") else n <= 10 or name == "order"


def test_exact_chains_of_colliding_keys(odd, documents):
    for docs in (odd, documents):
        plain = sorted(map(str, exact_duplicates(docs).collect()))
        assert plain == sorted(map(str, exact_duplicates(docs, key_bits=2, bucket_bytes=1 << 12).collect()))


def test_odd_rows_results(spark, odd):
    groups = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(odd).collect()}
    assert groups[1] == (2, 3) and groups[3] == (4, 2) and groups[None] == (None, 1)
    parts = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(odd).collect()}
    assert parts[2][1] == 1 and parts[7][1] == 6 and parts[4] == (0, 4) and parts[None][1] is None
    repeats = {r.doc_id: r for r in remove_repeats(odd).collect()}
    assert repeats[7].text == "tail" and repeats[6].spans == [] and repeats[3].text == ""
    kept = {r.doc_id: r.text for r in line_report(odd).collect()}
    assert kept[2] == "alpha BETA gamma delta." and kept[5] == " \n\t " and kept[3] is None


def test_short_items_and_shards(spark, odd, monkeypatch):
    from tideline.llm import leaks

    items = [(i, f"word{i} x{i} word{i + 1} x{i + 1} word{i + 2} x{i + 2}") for i in range(40)] + [(99, "beta gamma")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r.row.doc_id: (r.spans, r["items"]) for r in find_leaks(odd, bench, window=4).collect()}
    assert whole[1][1] == ["99"] and [tuple(s) for s in whole[1][0]] == [(1, 3)]
    assert whole[6][1] == sorted(str(i) for i in range(40))
    monkeypatch.setattr(leaks, "SHARD_BYTES", 512)
    split = {r.row.doc_id: (r.spans, r["items"]) for r in find_leaks(odd, bench, window=4).collect()}
    assert split == whole


def test_cut_leaves_the_rest(spark):
    docs = spark.createDataFrame([(1, "Keep this, but NOT beta Gamma here.", 3)], "doc_id long, text string, n long")
    bench = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    assert decontaminate(docs, bench).first().text == "Keep this, but NOT  here."


def test_token_counts_equal_the_library(documents, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    special = documents.sparkSession.createDataFrame([(1, "<|endoftext|>It's 12 ΑΣ<|startoftext|>x"), (2, "a" * 3000)], "doc_id long, text string")
    for docs in (documents, odd, special):
        texts = [r.text or "" for r in docs.select("doc_id", "text").collect()]
        want = sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
        assert sorted(r.n_tokens for r in token_counts(docs, WORDS).collect()) == want


def test_pieces_equal_the_library(documents, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (documents, odd):
        for r in decode(encode(docs, MODEL), MODEL).collect():
            assert r["ids"] == (library.encode(r.text) if r.text else []) and r.decoded == (r.text or "")


def test_slots_are_a_permutation_and_read_back(documents, tmp_path):
    import numpy as np
    import tiktoken

    from tideline.llm.training_order import Feistel

    for n in (1, 2, 3, 1000, 4097):
        order = Feistel(n, b"k")
        slots = order.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (order.number(slots) == np.arange(n)).all()
    ranks = read_ranks(workload.tokenizer("byte_bpe_50k.tiktoken"), workload.SPLIT_PATTERN)
    layout, written = write_training_order(documents, str(tmp_path / "s"), ranks, 50256, b"k", length=128, shard_bytes=1 << 14)
    rows = written.collect()
    assert sorted(r.slot for r in rows) == list(range(layout.sequences))
    encoding = tiktoken.Encoding("t", pat_str=ranks["pattern"], mergeable_ranks=ranks["ranks"], special_tokens={})
    tokens = {r.doc_id: encoding.encode_ordinary(r.text or "") + [50256] for r in documents.collect()}
    slots = list(read_slots(str(tmp_path / "s"), 0, layout.sequences))
    for r in rows:
        assert slots[r.slot][: r.n_tokens].tolist() == tokens[r.doc_id][128 * r.seq_no : 128 * (r.seq_no + 1)]
    assert (next(read_slots(str(tmp_path / "s"), 150, 1)) == slots[150]).all()


def test_surrogates_keep_distinct_and_same(spark, monkeypatch):
    from tideline.llm import surrogates

    texts = [
        (1, "Write to Ann.Lee@x.org or +49 171 5550001; Mrs. Anna Meier met Herr Karl."),
        (2, "ann.lee@x.org, 10.0.0.7, 4111 1111 1111 1111, Mrs. Anna Meier"),
        (3, "4111-1111-1111-1111 and 10.0.0.8 but no 4111111111111112"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.text for r in replace_personal_data(docs, b"k").collect()}
    for secret in ("Lee", "lee", "5550001", "Meier", "1111 1111", "10.0.0.7"):
        assert not any(secret in t for t in got.values())
    assert re.search(r"\S+@\S+\.org", got[1])[0].lower() == re.search(r"\S+@\S+\.org", got[2])[0].lower()
    assert "4111111111111112" in got[3] and re.search(r"Mrs\. \w+ \w+", got[1])[0] in got[2]
    cards = [re.sub(r"\D", "", re.search(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[i])[0]) for i in (2, 3)]
    assert cards[0] == cards[1] and surrogates._luhn(cards[0]) == 0
    # every first draw collides: the second one has to part the entities
    real = surrogates.surrogate
    clash = lambda key, kind, entity, attempt: "10.9.9.9" if kind == "ip" and not attempt else real(key, kind, entity, attempt)
    monkeypatch.setattr(surrogates, "surrogate", clash)
    found = spark.createDataFrame([("ip", "10.0.0.7"), ("ip", "10.0.0.8")], "kind string, entity string")
    table = {r.entity: r.new for r in surrogates.draw_surrogates(found, b"k").collect()}
    assert len(set(table.values())) == 2


def test_quality_finds_held_out_junk(spark):
    d = SF_DIR.replace("sf0.001", "sf0.01")
    scored = QUERIES["op1_quality_classifier"](spark, d).join(workload.table(spark, d, "labels"), "doc_id")
    right = scored.where("held_out").selectExpr("avg(cast(predicted = quality as int)) as share").first().share
    assert right > 0.9


def test_surrogates_of_whole_names(spark):
    names = [
        "Mr O'Brien", "Ms Anna Meier-Schmidt", "Mrs. Maria Garcia Lopez", "Dr. John F. Kennedy", "Prof. Dr. Anna Meier",
        "Frau Dr. Meier", "Herr Ludwig van Beethoven", "Mr. J.R. Smith", "Mr. d'Alba", "Mrs. JONES", "Госпожа Анна Петрова",
    ]
    rows = [(i, f"so {n}'s house, then {n} and Mrs. Last met them.") for i, n in enumerate(names)]
    got = replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    for r in got:
        for word in re.findall(r"[^\W\d_]{2,}", names[r.doc_id]):
            assert word in ("Mr", "Ms", "Mrs", "Dr", "Prof", "Frau", "Herr", "van", "Госпожа") or word not in r.text, r
        title = re.match(r"(?:(?:Mr|Ms|Mrs|Dr|Prof|Frau|Herr|Госпожа)\.? )+", names[r.doc_id])[0]
        one = re.fullmatch(rf"so ({re.escape(title)}.+)'s house, then (.+) and Mrs\. (\w+) met them\.", r.text)
        assert one and one[1] == one[2] and one[3] != "Last" and r.n_replaced == 3
    assert re.search(r"Dr\. \w+ (?!F)[A-Z]\. \w+", got[[r.doc_id for r in got].index(3)].text)


def test_surrogates_of_one_person(spark):
    from tideline.llm import surrogates

    texts = [
        (1, "Mr. John Smith came. Mr. Smith left."),
        (2, "Mrs Anna Meier, Dr Anna Meier, Dr Meier, Frau Dr. MEIER"),
        (3, "Dr. Kim Jones, Mrs. Kim Jones, Dr. Anna Jones, Mr. Anton Smith"),
        (4, "; ".join(f"{t} {f} Family{c}" for c in "abcdefgh" for t, f in (("Dr.", f"Kai{c}"), ("Mrs.", f"Lea{c}"), ("Mr.", f"Ron{c}")))),
    ]
    got = {r.doc_id: r.text for r in replace_personal_data(spark.createDataFrame(texts, "doc_id long, text string"), b"k").collect()}
    john, smith, again = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Mr\. (\w+) left\.", got[1]).groups()
    assert smith == again and john not in ("John", smith)
    a = re.fullmatch(r"Mrs (\w+) (\w+), Dr (\w+) (\w+), Dr (\w+), Frau Dr\. (\w+)", got[2]).groups()
    assert a[0] == a[2] and a[1] == a[3] == a[4] and a[5] == a[1].upper()
    b = re.fullmatch(r"Dr\. (\S+) (\w+), Mrs\. (\S+) (\w+), Dr\. (\S+) (\w+), Mr\. (\S+) (\w+)", got[3]).groups()
    female = surrogates.FIRST_NAMES["LATIN", "f"]
    assert b[0] == b[2] and b[1] == b[3] == b[5] and b[4] == a[0] and b[7] == smith
    assert set(b[0].split("-")) | set(b[4].split("-")) <= set(female)
    # 24 first and 8 family names stay that many, whatever the titles and however few names are drawn from
    names = [re.match(r"\w+\. (\S+) (\S+)", n).groups() for n in got[4].split("; ")]
    assert len({f for f, _ in names}) == 24 and len({f for _, f in names}) == 8
    for i, t in enumerate(texts):
        assert not set(re.findall(r"[A-Z]\w{3,}", t[1])) & set(re.findall(r"[A-Z]\w{3,}", got[i + 1])) - {"Frau"}


def test_surrogates_of_cards_in_longer_runs_and_of_secrets(spark):
    from tideline.llm.surrogates import mentions

    card = "4111111111111111"
    texts = [
        f"order 3 {card}", "cards: 12 4111 1111 1111 1111", f"{card} 4111-1111-1111-1111 17", "2024 01 02 378282246310005 9", f"3.50 {card}, x",
        'token = "0f3a9c4d5e6b7a8091a2b3c4d5e6f708192a3b4c"', "API_KEY: 'aB3/xY9+kLmN0pQrStUv=='",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in replace_personal_data(rows, b"k").collect()}
    for i, t in enumerate(texts):
        assert len(got[i]) == len(t) and got[i] != t
        for secret in (card, "1111 1111", "1111-1111", "378282246310005", "0f3a9c4d", "aB3/xY9"):
            assert secret not in got[i]
    assert got[0].startswith("order 3 4") and got[1].startswith("cards: 12 4") and got[2].endswith(" 17") and got[3].startswith("2024 01 02 3")
    assert re.fullmatch('token = "[0-9a-f]{40}"', got[5]) and re.fullmatch("API_KEY: '[^']{20}=='", got[6])
    assert [m[2] for m in mentions("1990 1991 1992 1993 1994 1995, key = internationalisation and 4111111111111112")] == []


def test_slots_do_not_depend_on_file_splits(spark, documents, tmp_path):
    documents.repartition(1).write.option("parquet.block.size", 1 << 14).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    ranks = read_ranks(workload.tokenizer("byte_bpe_50k.tiktoken"), workload.SPLIT_PATTERN)
    got = []
    for name, size in (("a", "128m"), ("b", "8k")):
        layout, written = write_training_order(docs, f"{tmp_path}/{name}", ranks, 50256, b"k", length=128, shard_bytes=1 << 14)
        # executors that come or go have the same effect on the second pass
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted(r.slot for r in written.collect()) == list(range(layout.sequences))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        got.append([s.tolist() for s in read_slots(f"{tmp_path}/{name}", 0, layout.sequences)])
    assert got[0] == got[1]


def test_repeated_items_count_once(spark, odd, monkeypatch):
    from tideline.llm import leaks

    sizes, real = [], leaks._vocabulary
    monkeypatch.setattr(leaks, "_vocabulary", lambda texts: sizes.append(len(texts)) or real(texts))
    monkeypatch.setattr(leaks, "SHARD_BYTES", 512)
    bench = spark.createDataFrame([(1, "beta gamma"), (2, "second line")] * 200, "item_id long, text string")
    found = {r.row.doc_id: r["items"] for r in find_leaks(odd, bench).collect()}
    assert found[1] == ["1", "2"] and sizes == [2]


def test_pieces_of_words_of_many_lengths_together(monkeypatch):
    import sentencepiece

    from tideline.llm import sentence_pieces

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(sentence_pieces, "PAIR_BITS", 3)  # pairs take each other's places
    viterbi = sentence_pieces.Viterbi(sentence_pieces.read_model(MODEL))
    calls, segment = [], viterbi.segment
    viterbi.segment = lambda words: calls.append(len(words)) or segment(words)
    texts = ["a bb the international counterrevolutionaries жж\n", "x" * 63 + " " + "y" * 64 + " " + "zé" * 40, "lower lowest low  " * 9]
    got = sentence_pieces.encode_texts(texts, viterbi)
    assert [memoryview(x).cast("i").tolist() for x in got] == [library.encode(t) for t in texts]
    # one matrix for all words of up to LONG_WORD characters, where each length had its own
    assert max(calls) >= 10


def test_joined_pairs_of_one_place():
    import numpy as np

    from tideline.llm import sentence_pieces

    viterbi = sentence_pieces.Viterbi(sentence_pieces.read_model(MODEL))
    rows = np.random.default_rng(3).integers(0, len(viterbi.keys), (2, 4000))
    want = viterbi._stay_apart(*rows)
    for _ in range(2):
        assert (viterbi._admitted(*rows) == want).all()


def test_sequences_are_written_to_disk_once_on_their_way(spark, documents, tmp_path, monkeypatch):
    from tideline.llm import training_order

    tables, materialise = [], training_order.materialise
    monkeypatch.setattr(training_order, "materialise", lambda df: tables.append(df.columns) or materialise(df))
    ranks = read_ranks(workload.tokenizer("byte_bpe_50k.tiktoken"), workload.SPLIT_PATTERN)
    layout, written = write_training_order(documents, str(tmp_path / "s"), ranks, 50256, b"k", length=64, shard_bytes=1 << 13)
    assert all("tokens" not in columns for columns in tables)
    rows = sorted(written.collect(), key=lambda r: r.slot)
    slots = list(read_slots(str(tmp_path / "s"), 0, layout.sequences))
    assert len({r.shard for r in rows}) > 5 and len(slots) == len(rows)
    import zlib

    for r, slot in zip(rows, slots, strict=True):
        assert zlib.crc32(slot.tobytes()) == r.crc
        assert r.slot == layout.first_slots[r.shard] + r.byte_offset // layout.stride
    assert len({(r.doc_id, r.seq_no) for r in rows}) == len(rows)


def test_only_wanted_texts_are_sent(spark):
    from tideline.llm.ngram_join import _texts_of

    docs = spark.range(4000).selectExpr("if(id % 7 = 0, null, id) AS doc_id", "concat('text ', id) AS text")
    wanted = docs.where("doc_id % 40 = 1").selectExpr("doc_id AS node", "doc_id AS doc", "cast(text AS binary) AS digest")
    got = sorted((r.doc, r._text) for r in _texts_of(docs, wanted).collect())
    assert got == sorted((r.doc, bytes(r.digest).decode()) for r in wanted.collect())


def test_table_of_wanted_documents_excludes_most_others(spark):
    from tideline.llm import ngram_join

    hashes = spark.range(2000).selectExpr("xxhash64(id) AS hash")
    table = spark.sparkContext.broadcast(ngram_join._wanted_table(hashes))
    rows = spark.range(20000).selectExpr("id AS doc", "'t' AS _text", "xxhash64(id) AS hash")
    kept = {r.doc for r in rows.mapInArrow(ngram_join._perhaps_wanted(table), "doc long, _text string").collect()}
    assert kept >= set(range(2000)) and len(kept) < 4000
