from collections import Counter

import pytest

import corpus_pipeline
from sievewright.llm import mix, pieces, pii, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    from sievewright.session import stage

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        docs = found[name] = stage(function(spark, docs, SF_DIR), name)
    return found


def test_stages_keep_the_columns(outputs):
    *stages, last = outputs.values()
    assert all(df.dtypes == stages[0].dtypes for df in stages)
    assert last.columns == ["doc_id", "source", "n_pieces", "ids"]


def test_language_keeps_documents_of_the_labelled_languages(outputs):
    kept = {r["doc_id"] for r in outputs["language"].collect()}
    assert kept == {r["doc_id"] for r in outputs["documents"].collect()}  # all are prose


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_of_each_group_stays(outputs):
    rows = {r["doc_id"]: shingle_set(r["text"]) for r in outputs["language"].collect()}
    ids = sorted(rows)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(rows[a] & rows[b])
            if rows[a] and rows[b] and 100 * common >= 75 * (len(rows[a]) + len(rows[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = sorted(r["doc_id"] for r in outputs["near_duplicates"].collect())
    assert kept == sorted({find(i) for i in ids})


def test_personal_data_goes_and_the_rest_stays(outputs):
    before = {r["doc_id"]: r["text"] for r in outputs["near_duplicates"].collect()}
    rows = outputs["personal_data"].collect()
    assert {r["doc_id"] for r in rows} == set(before)
    spans = {r["doc_id"]: r["pii"] for r in pii.find_spans(outputs["near_duplicates"]).collect()}
    assert any(spans.values())
    for r in rows:
        text, at, out = before[r["doc_id"]], 0, []
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        assert r["text"] == "".join([*out, text[at:]]) and r["n_chars"] == len(r["text"])


def test_mix_and_pieces(outputs):
    import sentencepiece

    before = {r["doc_id"]: r for r in outputs["personal_data"].collect()}
    rows = outputs["mix"].collect()
    assert {r["doc_id"] for r in rows} == set(before) and all(r == before[r["doc_id"]] for r in rows)
    n = Counter("=" + r["source"] for r in rows)
    counts = Counter("=" + r["source"] for r in before.values())
    shares = mix.whole_shares({s: c**mix.TEMPER for s, c in counts.items()}, mix.FRAME)
    assert all(abs(n[s] / mix.BLOCK_ROWS - len(rows) / mix.BLOCK_ROWS * a / mix.FRAME) < 1 for s, a in shares.items())
    model = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECES))
    final = outputs["pieces"].collect()
    assert Counter(r["doc_id"] for r in final) == Counter(r["doc_id"] for r in rows)
    assert all(r["ids"] == model.encode(before[r["doc_id"]]["text"]) and r["n_pieces"] == len(r["ids"]) for r in final)
    assert isinstance(pieces.load(queries.vocabulary_path(queries.PIECES)).unknown, int)


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, position string, score string, pii int, kept int"
    rows = [
        (1, "the cat and the dog went out", "en", "a", 28, "p"), (1, "the cat and the dog went out", "en", "a", 28, "p"),
        (2, None, None, None, None, None), (3, "", "en", "a", 0, None), (None, "der Hund und die Katze", "de", None, 22, ""),
        (4, "1234 ...", "en", "b", 8, None), (5, "mail a@b.cc to the dog and the cat", None, "b", 34, None), (6, "w " * 9000, "en", "a", 18000, "x"),
    ]
    rows = [(*r, "s", 1, 2) for r in rows]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, function in corpus_pipeline.STAGES[:-1]:
            docs = function(spark, docs, SF_DIR)
            assert docs.dtypes == table.dtypes, name
        found = {r["doc_id"] for r in corpus_pipeline.encoded(spark, docs, SF_DIR).collect()}
        assert found == ({1, None, 5, 6} if table.count() else set())
