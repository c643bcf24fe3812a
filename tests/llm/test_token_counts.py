import tiktoken
import pytest
from tenure.llm import token_counts


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(token_counts.VOCABULARY), special_tokens={})


def brute(encoding, fields, rule):
    """Section tokens from the bytes that each token covers, one at a time."""
    text, owner = b"", []
    section = -1
    for k, field in enumerate(fields):
        body = field.encode()
        *lines, last = body.split(b"\n")
        lines = [line + b"\n" for line in lines] + ([last] if last or not lines else [])
        for line in lines:
            section += 1
            owner += [section] * len(line)
        if k + 1 < len(fields):
            body += b"\n\n"
            owner += [section] * 2
        text += body
    counts, crossing, at = [0] * (section + 1), 0, 0
    for token in encoding.encode_ordinary(text.decode()):
        covered = owner[at : at + len(encoding.decode_single_token_bytes(token))]
        at += len(covered)
        crossing += len(set(covered)) > 1
        counts[covered[0] if rule == "start" else max(dict.fromkeys(covered), key=covered.count)] += 1
    assert at == len(text)
    return counts, crossing


TEXTS = ["", "one line", "two\nlines", "ends\n", "\n\n\n", "a.\n\n\nb", "üñï çödé\n日本語 テキスト\n🙂🙂", "<|endoftext|> x", "tab\t\n  indented\n", "  \n \n  x"]


@pytest.mark.parametrize("rule", ["start", "most"])
def test_equals_brute_force(frame, encoding, rule, long_text):
    rows = [(i, t) for i, t in enumerate([*TEXTS, long_text])]
    for r in token_counts.count_tokens(frame("doc_id long, text string", rows), rule=rule).collect():
        counts, crossing = brute(encoding, [r["text"]], rule)
        assert [s["tokens"] for s in r["sections"]] == counts
        assert (r["n_crossing"], r["n_tokens"], r["n_sections"]) == (crossing, sum(counts), len(counts))
        assert "".join(r["text"][s["start"] : s["end"]] for s in r["sections"]) == r["text"]


def test_fields_are_encoded_together(frame, encoding):
    rows = [(1, "A title", "body\nof text"), (2, None, "only body"), (3, "only title", ""), (4, None, None), (3, "only title", "")]
    for r in token_counts.count_tokens(frame("doc_id long, title string, text string", rows), fields=("title", "text")).collect():
        fields = [r["title"] or "", r["text"] or ""]
        counts, _ = brute(encoding, fields, "start")
        assert [s["tokens"] for s in r["sections"]] == counts
        assert r["n_tokens"] == len(encoding.encode_ordinary("\n\n".join(fields)))
        assert {s["field"] for s in r["sections"]} == {"title", "text"}


def test_empty_table_and_clashing_columns(frame):
    assert token_counts.count_tokens(frame("doc_id long, text string", [])).count() == 0
    out = token_counts.count_tokens(frame("doc_id long, text string, Sections int, tokens int", [(1, "x", 2, 3)]))
    assert out.columns == ["doc_id", "text", "tokens", *token_counts.PRODUCED]
    with pytest.raises(ValueError):
        token_counts.count_tokens(out, rule="other")
