"""Readers of the public conformance formats (tree-construction .dat, tokenizer .test, encoding .dat), run on samples here.

Set HTML5LIB_TESTS to a checkout of the corpus to run it too; its failures are counted, not listed.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest

from sparkdom.html.encoding import normalize_label, sniff
from sparkdom.html.parse import parse
from sparkdom.html.serialize import to_test_format
from sparkdom.html.tokenizer import Tokenizer

STATES = {"Data state": "data", "PLAINTEXT state": "plaintext", "RCDATA state": "rcdata", "RAWTEXT state": "rawtext", "Script data state": "script", "CDATA section state": "cdata"}
CORPUS = Path(os.environ.get("HTML5LIB_TESTS", "/nonexistent"))


def read_dat(text: str) -> list[dict[str, str]]:
    """Blocks of `#section` lines; a block begins at every #data."""
    out, section = [], None
    for line in text.split("\n"):
        if line == "#data":
            out.append({})
        if line.startswith("#") and line[1:] in ("data", "errors", "new-errors", "document-fragment", "document", "script-on", "script-off", "encoding", "xml-coercion", "iframe-srcdoc"):
            section = line[1:]
            out[-1][section] = None
        elif out:
            have = out[-1][section]
            out[-1][section] = line if have is None else f"{have}\n{line}"
    for case in out:
        if case.get("document"):
            case["document"] = case["document"].rstrip("\n")
    return out


def tree_case(case: dict[str, str]) -> bool | None:
    """Whether the dump is as it should be; None for cases that need scripts."""
    if "script-on" in case:
        return None
    context = None
    if case.get("document-fragment"):
        ns, _, name = case["document-fragment"].rpartition(" ")
        context = (name, ns or "html")
    root = parse(case["data"] or "", context=context, iframe_srcdoc="iframe-srcdoc" in case, xml="xml-coercion" in case).root
    return to_test_format(root) == (case.get("document") or "")


class Recorder:
    def __init__(self, foreign: bool):
        self.tokens, self.cdata = [], foreign

    def foreign(self) -> bool:
        return self.cdata

    def start(self, name, attrs, self_closing):
        self.tokens.append(["StartTag", name, attrs, True] if self_closing else ["StartTag", name, attrs])

    def end(self, name):
        self.tokens.append(["EndTag", name])

    def chars(self, text):
        if self.tokens and self.tokens[-1][0] == "Character":
            self.tokens[-1][1] += text
        else:
            self.tokens.append(["Character", text])

    def comment(self, data):
        self.tokens.append(["Comment", data])

    def doctype(self, name, public, system, quirks):
        self.tokens.append(["DOCTYPE", name, public, system, not quirks])

    def eof(self):
        pass


def tokenizer_case(case: dict) -> list[bool]:
    data, want = case["input"], case["output"]
    if case.get("doubleEscaped"):
        undo = lambda s: s.encode("latin-1", "backslashreplace").decode("unicode_escape") if isinstance(s, str) else s
        data, want = undo(data), [[undo(x) if not isinstance(x, dict) else {undo(k): undo(v) for k, v in x.items()} for x in t] for t in want]
    out = []
    for state in case.get("initialStates", ["Data state"]):
        sink = Recorder(state == "CDATA section state")
        Tokenizer(data, sink, state=STATES[state], last_start=case.get("lastStartTag", ""), discard_bom=case.get("discardBom", False)).run()
        out.append(sink.tokens == want)
    return out


SAMPLE = """#data
<p>One<p>Two
#errors
(1,3): expected-doctype-but-got-start-tag
#document
| <html>
|   <head>
|   <body>
|     <p>
|       "One"
|     <p>
|       "Two"

#data
<td>x
#errors
#document-fragment
tr
#document
| <td>
|   "x"

#data
<a xlink:href=b>
#errors
#document-fragment
svg svg
#document
| <svg a>
|   xlink href="b"

#data
<noscript>x
#errors
#script-on
#document
| <html>
"""


def test_tree_samples():
    assert [tree_case(c) for c in read_dat(SAMPLE)] == [True, True, True, None]


@pytest.mark.parametrize(
    "case",
    [
        {"input": "<!DOCTYPE html PUBLIC 'a' \"b\">x", "output": [["DOCTYPE", "html", "a", "b", True], ["Character", "x"]]},
        {"input": "<!DOCTYPE>", "output": [["DOCTYPE", None, None, None, False]]},
        {"input": "<h a='b' c=d/>x</h e>", "output": [["StartTag", "h", {"a": "b", "c": "d/"}], ["Character", "x"], ["EndTag", "h"]]},
        {"input": "<h a/>", "output": [["StartTag", "h", {"a": ""}, True]]},
        {"input": "&lt;</xmp>&amp;", "initialStates": ["RCDATA state"], "lastStartTag": "xmp", "output": [["Character", "<"], ["EndTag", "xmp"], ["Character", "&"]]},
        {"input": "&lt;</XMP >&amp;", "initialStates": ["RAWTEXT state", "Script data state"], "lastStartTag": "xmp", "output": [["Character", "&lt;"], ["EndTag", "xmp"], ["Character", "&"]]} | {"initialStates": ["RAWTEXT state"]},
        {"input": "a<b>&amp;", "initialStates": ["PLAINTEXT state"], "output": [["Character", "a<b>&amp;"]]},
        {"input": "a&lt;]]>b", "initialStates": ["CDATA section state"], "output": [["Character", "a&lt;b"]]},
        {"input": "<!--a--!>b<!-->c<!--->d<!--e", "output": [["Comment", "a"], ["Character", "b"], ["Comment", ""], ["Character", "c"], ["Comment", ""], ["Character", "d"], ["Comment", "e"]]},
        {"input": "<?x></?y></>z<", "output": [["Comment", "?x"], ["Comment", "?y"], ["Character", "z<"]]},
        {"input": "\\u0000<a\\u0000>", "doubleEscaped": True, "output": [["Character", "\\u0000"], ["StartTag", "a\\uFFFD", {}]]},
        {"input": "<a b=1 b=2 =c>", "output": [["StartTag", "a", {"b": "1", "=c": ""}]]},
        {"input": "<a", "output": []},
    ],
)
def test_tokenizer_samples(case):
    assert all(tokenizer_case(case))


def test_encoding_samples():
    for case in read_dat('#data\n<meta charset="euc-jp">\n#encoding\nEUC-JP\n\n#data\n<!-- x --><meta http-equiv=content-type content="text/html; charset=cp1251">\n#encoding\nwindows-1251\n'):
        assert sniff(case["data"].encode())[0] == normalize_label(case["encoding"].strip())


@pytest.mark.skipif(not CORPUS.is_dir(), reason="no corpus at HTML5LIB_TESTS")
def test_corpus():
    trees = [r for p in CORPUS.glob("tree-construction/**/*.dat") for c in read_dat(p.read_text()) if (r := tree_case(c)) is not None]
    tokens = [r for p in CORPUS.glob("tokenizer/*.test") for c in json.loads(p.read_text()).get("tests", ()) for r in tokenizer_case(c)]
    print(f"trees {sum(trees)}/{len(trees)}, tokens {sum(tokens)}/{len(tokens)}")
    assert sum(trees) > 0.95 * len(trees) and sum(tokens) > 0.95 * len(tokens)
