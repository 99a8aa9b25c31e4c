"""Writes a workbook of small sheets, for tests of the reader."""

import zipfile
from xml.sax.saxutils import escape


def letters(n):
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def write(path, sheets):
    """sheets: name to rows of None, text, int or float; texts of the first sheet are shared, of others inline."""
    shared = []
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            out = []
            for r, row in enumerate(sheets[n], 1):
                cells = []
                for c, v in enumerate(row, 1):
                    at = f'r="{letters(c)}{r}"'
                    if v is None:
                        continue
                    if isinstance(v, str) and i == 0:
                        shared.append(v)
                        cells.append(f'<c {at} t="s"><v>{len(shared) - 1}</v></c>')
                    elif isinstance(v, str):
                        cells.append(f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                    else:
                        cells.append(f"<c {at}><v>{v!r}</v></c>")
                if cells:
                    out.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
