"""The operators' small documents, without Spark; and all that is registered has a name of its own."""

from __future__ import annotations

import pandas as pd
import pytest

from sparkdom import cases, queries
from sparkdom.html.parse import parse
from sparkdom.html.serialize import to_html

EVERY = [(name, fn, given, want, table is cases.BYTES) for table in (cases.TEXTS, cases.BYTES) for name, (fn, listed) in table.items() for given, want in listed]


@pytest.mark.parametrize(("name", "fn", "given", "want", "binary"), EVERY, ids=[f"{c[0]}-{k}" for k, c in enumerate(EVERY)])
def test_case(name, fn, given, want, binary):
    value = b"17".join(bytes.fromhex(x) for x in given.split("{}")) if binary else given.replace("{}", "17")
    assert fn.func(pd.Series([value])).iloc[0] == (None if want is None else want.replace("{}", "17"))


def test_doctypes_of_real_pages():
    """A public identifier may stand alone, as on many old pages."""
    for given, want in (('<!DOCTYPE HTML PUBLIC "-//W3C//DTD HTML 4.01//EN"><p>', '<!DOCTYPE html PUBLIC "-//W3C//DTD HTML 4.01//EN">'), ("<!DOCTYPE html SYSTEM 'about:legacy-compat'>", '<!DOCTYPE html SYSTEM "about:legacy-compat">'), ("<!DOCTYPE html>", "<!DOCTYPE html>")):
        assert to_html(parse(given).root, False).startswith(want + "<html>")


def test_sql_for_every_case():
    assert cases.QUERIES.keys() == cases.ORACLE_SQL.keys() <= queries.QUERIES.keys()
