"""Row types of parsed pages."""

from __future__ import annotations

DOCTYPE = "struct<name: string, public_id: string, system_id: string, force_quirks: boolean>"
NODE = (
    "tree_id: int, node_id: int, last_id: int, parent_id: int, owner_id: int, depth: int, kind: string, name: string, ns: string, "
    f"attrs: map<string, string>, data: string, doctype: {DOCTYPE}, "
    "elem_pos: int, elem_cnt: int, type_pos: int, type_cnt: int, prev_elem_id: int, is_empty: boolean, "
    "text_from: int, text_to: int, html_from: int, html_to: int"
)
ERROR = "seq: int, phase: string, code: string, line: int, column: int"
#: Columns of a parsed page besides its key.
PAGE = f"encoding string, quirks string, html string, texts array<string>, nodes array<struct<{NODE}>>, errors array<struct<{ERROR}>>"
EVENT = f"seq int, event string, name string, attrs map<string, string>, text string, doctype {DOCTYPE}"
