"""Comments and literals against texts whose parts are known."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import lexing
from corpusloom.operators import chunk, filters

#: By language, parts that are comments or literals, whatever brackets and quotes they hold.
HIDDEN = {
    "java": ['"a { \\" ( "', "'{'", "'\\''", "// { ' \"\n", "/* { // \" ' \n } ) */", '"""\n { " "" \\""" ( \n"""', '"\\\\"'],
    "cpp": ['"a { \\" ( "', "'{'", "L'\\''", "// { ' \"\n", "/* { // \" ' \n } */", 'R"( { " \' ) )"', 'u8R"x( )" } )y" )x"', "\n#define X { ( \\\n } \" '\n", '"\\\\"'],
    "csharp": ['"a { \\" ( "', "'{'", "// { '\n", "/* { \" \n } */", '@"c:\\ { "" ( \n"', '$@"{x} "" ("', '"""\n { " "" (\n"""', "\n#region { ' \"\n"],
    "rust": ['"a { \\" \n ( "', "'{'", "'\\''", "'\\u{7b}'", "b'('", "// { ' \"\n", "/* { /* ( */ // \" ' \n } */", 'r"\\ { "', 'r##" { "# ( "##', '"\\\\"'],
    "javascript": ['"a { \\" ( "', "'{'", "'\\''", "// { ' \" `\n", "/* { // \" ' ` \n } */", "`a { ( \\` $ \n '`", '"\\\\"'],
}
HIDDEN["typescript"] = HIDDEN["javascript"]
PLAIN = {"java": [" x = 1; ", " { ", " } ", "( a / b )", "\n"], "cpp": [" n = 1'000'000; ", " { ", " } ", "( a / b )", "\n"], "csharp": [" x = 1; ", " { ", " } ", "( a / b )", "\n"], "rust": [" fn f<'a>(x: &'a str) ", " { ", " } ", "( a / b )", "\n"], "javascript": [" x = a / b; ", " { ", " } ", "( a ) / 2", "\n", " = /[/{'\"`]\\/{/g ; "]}
PLAIN["typescript"] = PLAIN["javascript"]


def parts(language):
    return st.lists(st.tuples(st.just(True), st.sampled_from(HIDDEN[language])) | st.tuples(st.just(False), st.sampled_from(PLAIN[language])), max_size=12)


@pytest.mark.parametrize("language", sorted(HIDDEN))
def test_known_parts(language):
    blank = lambda t: "".join(ch if ch == "\n" else " " for ch in t)

    @settings(max_examples=250, deadline=None)
    @given(parts(language))
    def check(found):
        text = ";".join(t for _, t in found)
        want = ";".join(blank(t) if hidden else t.replace("/[/{'\"`]\\/{/g", " " * 13) for hidden, t in found)
        lines = [x if "#" in a else y for a, x, y in zip(text.split("\n"), want.split("\n"), want.split("\n"))]
        got = lexing.blanked(text, language)
        assert len(got) == len(text) and got.count("\n") == text.count("\n")
        if language in ("cpp", "csharp"):  # prefixes of literals are words, and a directive takes its whole line
            got, lines = (["".join(ch for ch in x if ch in "([{}])") for x in y] for y in (got.split("\n"), lines))
            assert sum(map(len, got)) <= sum(map(len, lines)) if "#" in text else got == lines
        elif language == "rust":
            assert [ch for ch in got if ch in "([{}])"] == [ch for ch in want if ch in "([{}])"]
        else:
            assert got == want

    check()


def test_templates_hold_code():
    code = "f(`a { ${g({b: `}${h}`})} ( `, {x})"
    assert "".join(ch for ch in lexing.blanked(code, "javascript") if ch in "([{}])") == "(({}){})"
    assert lexing.depths("(/*(*/)", "java") == [1, 1, 1, 1, 1, 1, 0]


def test_open_ends():
    assert lexing.blanked('x = "a {\ny {', "java") == "x =     \ny {"
    assert lexing.blanked("a /* {\n{", "cpp") == "a     \n "
    assert lexing.blanked("a /* /* */ {", "rust").strip() == "a" and lexing.blanked("`${", "javascript") == "   "
    assert lexing.blanked("", "java") == "" and lexing.blanked('"' + "\\n" * 200_000, "cpp").strip() == ""


CHUNKS = {
    "java": ("/* class No {\n*/\nclass A {\n  String s = \"}\"; // }\n  char c = '}';\n  String t = \"\"\"\n  }\n  \"\"\";\n}\nint x;\n", [("class", "A", 3, 9)]),
    "cpp": ("struct B {\n  const char* r = R\"x(\n} )\" )x\"; int n = 1'000;\n/*\n}\n*/\n};\n", [("class", "B", 1, 7)]),
    "rust": ("/* fn no() { /* } */ */\nfn f(x: &'static str) -> char {\n  let s = r#\"}\"#;\n  '}'\n}\n", [("function", "f", 2, 5)]),
    "javascript": ("// function no() {\nfunction f(a) {\n  const r = /[}]/g, t = `}\n${a ? `}` : '}'}`;\n  return a / 2;\n}\n", [("function", "f", 2, 6)]),
}


@pytest.mark.parametrize("language", sorted(CHUNKS))
def test_blocks_and_brackets_of_adversarial_code(language):
    code, want = CHUNKS[language]
    assert [(c["chunk_type"], c["symbol"], c["start_line"], c["end_line"]) for c in chunk.brace_chunks(code, language)] == want
    assert filters.error_ratio(language, code) == 0.0
    assert filters.error_ratio(language, code + "}") > 0
