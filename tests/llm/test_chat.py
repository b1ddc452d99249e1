from hypothesis import given, settings, strategies as st

from cargolens.llm import chat as C

PIECES = st.sampled_from([*C.CONTROL, "\\", "<", "[", "a", "é", "\n", "|", "\\[INST]", "/"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in C.CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>"]), st.lists(PIECES, max_size=6).map("".join)),
                max_size=6))
def test_turns_are_read_back(turns):
    out = C.Rendering()
    for role, text in turns:
        out.visit_turn(role, [{"kind": "text", "text": text, "ref": None, "size": None}], role == "assistant")
    formatted = "".join(out.pieces)
    assert list(C.parse(formatted)) == turns
    assert [C.unescape(formatted[s["start"]:s["stop"]]) for s in out.spans] == [t for r, t in turns if r == "assistant"]
    assert out.length == len(formatted)


def test_typed_parts_become_placeholders_in_order(make):
    part = "kind string, text string, ref string, size bigint"
    rows = [(1, 0, "user", [("text", "look: <|image|>", None, None), ("image", None, "a.png", 28 * 28 * 3),
                            ("text", "and", None, None), ("audio", None, "b.wav", 81), ("document", None, None, None)]),
            (1, 1, "assistant", [("text", "ok", None, None)]), (2, 0, None, None), (2, 0, None, None)]
    df = make(rows, f"conv_id int, turn int, role string, parts array<struct<{part.replace(' ', ':').replace(',:', ',')}>>")
    got = {r.conv_id: r for r in C.format_conversations(df).collect()}
    one = got[1]
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 3), ("document", "", 1)]
    assert all(one.formatted[a.position:].startswith(f"<|{a.kind}|>") for a in one.attachments)
    assert one.expanded_tokens == 7
    content = one.formatted.split(C.BODY)[1].split(C.END)[0]
    assert C.split_parts(content) == [("text", "look: <|image|>"), ("image", ""), ("text", "and"), ("audio", ""), ("document", "")]
    assert got[2].n_turns == 2 and got[2].loss_spans == []


def test_nulls_ties_empty_tables_and_extra_columns(make):
    rows = [(None, None, None, None, 1), (None, 0, "user", "x", 2), (5, 1, "assistant", None, 3), (5, 1, "assistant", None, 3)]
    df = make(rows, "conv_id int, turn int, role string, text string, formatted int")
    got = {r.conv_id: r for r in C.digest(C.format_conversations(C.text_parts(df))).collect()}
    assert got[None].n_turns == 2 and got[5].n_turns == 2 and got[5].loss_chars == 0
    assert C.digest(C.format_conversations(C.text_parts(df.limit(0)))).count() == 0
