"""Which encoding bytes are in, and their text."""

from __future__ import annotations

import codecs
import re

#: Fixed values of the Encoding Standard: for each encoding the codec and the labels besides its name.
ENCODINGS = {
    "utf-8": ("utf-8", "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf8 x-unicode20utf8"),
    "ibm866": ("cp866", "866 cp866 csibm866"),
    "iso-8859-2": ("iso8859_2", "csisolatin2 iso-ir-101 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 l2 latin2"),
    "iso-8859-3": ("iso8859_3", "csisolatin3 iso-ir-109 iso8859-3 iso88593 iso_8859-3 iso_8859-3:1988 l3 latin3"),
    "iso-8859-4": ("iso8859_4", "csisolatin4 iso-ir-110 iso8859-4 iso88594 iso_8859-4 iso_8859-4:1988 l4 latin4"),
    "iso-8859-5": ("iso8859_5", "csisolatincyrillic cyrillic iso-ir-144 iso8859-5 iso88595 iso_8859-5 iso_8859-5:1988"),
    "iso-8859-6": ("iso8859_6", "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso8859-6 iso88596 iso_8859-6 iso_8859-6:1987"),
    "iso-8859-7": ("iso8859_7", "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso8859-7 iso88597 iso_8859-7 iso_8859-7:1987 sun_eu_greek"),
    "iso-8859-8": ("iso8859_8", "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso8859-8 iso88598 iso_8859-8 iso_8859-8:1988 visual"),
    "iso-8859-8-i": ("iso8859_8", "csiso88598i logical"),
    "iso-8859-10": ("iso8859_10", "csisolatin6 iso-ir-157 iso8859-10 iso885910 l6 latin6"),
    "iso-8859-13": ("iso8859_13", "iso8859-13 iso885913"),
    "iso-8859-14": ("iso8859_14", "iso8859-14 iso885914"),
    "iso-8859-15": ("iso8859_15", "csisolatin9 iso8859-15 iso885915 iso_8859-15 l9"),
    "iso-8859-16": ("iso8859_16", ""),
    "koi8-r": ("koi8_r", "cskoi8r koi koi8 koi8_r"),
    "koi8-u": ("koi8_u", "koi8-ru"),
    "macintosh": ("mac_roman", "csmacintosh mac x-mac-roman"),
    "windows-874": ("cp874", "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620"),
    "windows-1250": ("cp1250", "cp1250 x-cp1250"),
    "windows-1251": ("cp1251", "cp1251 x-cp1251"),
    "windows-1252": ("cp1252", "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii x-cp1252 utf-7 x-utf-7"),
    "windows-1253": ("cp1253", "cp1253 x-cp1253"),
    "windows-1254": ("cp1254", "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 x-cp1254"),
    "windows-1255": ("cp1255", "cp1255 x-cp1255"),
    "windows-1256": ("cp1256", "cp1256 x-cp1256"),
    "windows-1257": ("cp1257", "cp1257 x-cp1257"),
    "windows-1258": ("cp1258", "cp1258 x-cp1258"),
    "x-mac-cyrillic": ("mac_cyrillic", "x-mac-ukrainian"),
    "gbk": ("gbk", "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 iso-ir-58 x-gbk"),
    "gb18030": ("gb18030", ""),
    "big5": ("big5hkscs", "big5-hkscs cn-big5 csbig5 x-x-big5"),
    "euc-jp": ("euc_jp", "cseucpkdfmtjapanese x-euc-jp"),
    "iso-2022-jp": ("iso2022_jp", "csiso2022jp"),
    "shift_jis": ("cp932", "csshiftjis ms932 ms_kanji shift-jis sjis windows-31j x-sjis"),
    "euc-kr": ("cp949", "cseuckr csksc56011987 iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949"),
    "replacement": ("", "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr"),
    "utf-16be": ("utf-16-be", "unicodefffe"),
    "utf-16le": ("utf-16-le", "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16"),
    "x-user-defined": ("", ""),
}
LABELS = {label: name for name, (_, labels) in ENCODINGS.items() for label in (name, *labels.split())}
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))
FALLBACK = "windows-1252"
#: How much of the page the prescan reads: in all, and outside comments.
PRESCAN, PRESCAN_OUTSIDE = 65536, 1024

TOKEN = re.compile(rb"<!--|<meta(?=[\t\n\f\r /])|</?[a-zA-Z]|<[!/?]", re.I)
ATTRIBUTE = re.compile(rb"""[\t\n\f\r /]*([^\t\n\f\r />][^\t\n\f\r /=>]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*("[^"]*"|'[^']*'|[^\t\n\f\r >"'][^\t\n\f\r >]*|))?""")
CHARSET = re.compile(rb"charset[\t\n\f\r ]*=[\t\n\f\r ]*", re.I)


def normalize_label(label: str | bytes | None) -> str | None:
    """The encoding's name, or None for a label that nobody knows."""
    if label is None:
        return None
    if isinstance(label, bytes):
        label = label.decode("latin-1")
    return LABELS.get(label.strip("\t\n\f\r ").lower())


def _declared(name: str | None) -> str | None:
    """What a page says about itself cannot be UTF-16."""
    return "utf-8" if name in ("utf-16le", "utf-16be") else "windows-1252" if name == "x-user-defined" else name


def charset_of(content: bytes) -> str | None:
    """The label in a content attribute."""
    m = CHARSET.search(content)
    if not m:
        return None
    rest = content[m.end() :]
    if rest[:1] in (b'"', b"'") and rest:
        end = rest.find(rest[:1], 1)
        return rest[1:end].decode("latin-1") if end > 0 else None
    return re.split(rb"[\t\n\f\r ;]", rest)[0].decode("latin-1") or None


def _attributes(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    out: dict[bytes, bytes] = {}
    while m := ATTRIBUTE.match(data, at):
        value = m[2] or b""
        out.setdefault(m[1].lower(), value[1:-1] if value[:1] in (b'"', b"'") else value)
        at = m.end()
    end = data.find(b">", at)
    return out, len(data) if end < 0 else end + 1


def prescan(data: bytes) -> str | None:
    """The encoding that a <meta> near the top declares."""
    data = data[:PRESCAN]
    at, budget = 0, PRESCAN_OUTSIDE
    while at < len(data):
        m = TOKEN.search(data, at)
        if not m:
            return None
        budget -= m.start() - at
        if budget <= 0:
            return None
        token = m[0].lower()
        if token == b"<!--":
            end = data.find(b"-->", m.start() + 2)
            if end < 0:
                return None
            at = end + 3
            continue
        if token in (b"<!", b"</", b"<?"):
            end = data.find(b">", m.end())
            end = len(data) if end < 0 else end + 1
        else:
            name_end = m.end() if token == b"<meta" else re.compile(rb"[^\t\n\f\r />]*").match(data, m.end()).end()
            attrs, end = _attributes(data, name_end)
            if token == b"<meta":
                label = attrs[b"charset"].decode("latin-1") if b"charset" in attrs else charset_of(attrs[b"content"]) if attrs.get(b"http-equiv", b"").lower() == b"content-type" and b"content" in attrs else None
                if found := _declared(normalize_label(label)):
                    return found
        budget -= end - m.start()
        at = end
    return None


def sniff(data: bytes, transport: str | None = None) -> tuple[str, int]:
    """(encoding, length of the byte order mark): the transport's label, then the mark, then the page, then windows-1252."""
    bom = next(((name, len(mark)) for mark, name in BOMS if data.startswith(mark)), None)
    if name := normalize_label(transport):
        return name, bom[1] if bom is not None and bom[0] == name else 0
    return bom or (prescan(data) or FALLBACK, 0)


def decode_html(data: bytes, transport: str | None = None) -> tuple[str, str]:
    name, skip = sniff(data, transport)
    return decode(data[skip:], name), name


def decode(data: bytes, name: str) -> str:
    if name == "replacement":
        return "�" if data else ""
    if name == "x-user-defined":
        return "".join(chr(b if b < 0x80 else 0xF700 + b) for b in data)
    if name == "windows-1252":
        return data.decode("cp1252", "c1")
    return data.decode(ENCODINGS[name][0], "replace")


def _c1(e: UnicodeDecodeError) -> tuple[str, int]:
    """windows-1252 leaves no byte undefined: five stand for control characters."""
    return "".join(chr(b) for b in e.object[e.start : e.end]), e.end


codecs.register_error("c1", _c1)
