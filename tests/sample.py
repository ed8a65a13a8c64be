"""A page with two tables among prose, and a workbook made by hand."""

import io
import zipfile
from xml.sax.saxutils import escape

SAMPLE_PAGE = """<!DOCTYPE html>
<html><head><title>Guide to the bay</title><style>th { font-weight: normal }</style></head>
<body>
<h1>Harbour guide</h1><p>All lights <i>north of the bay</i>.</p>
<table>
  <thead><tr><th>Light</th><th>Year</th><th>Steps</th><th>Visitors</th><th>Range km</th><th>Open</th></tr></thead>
  <tbody>
    <tr><td>Grey Point</td><td>1874</td><td>212</td><td>48,310</td><td>31.5</td><td>yes</td></tr>
    <tr><td>Saint Orla</td><td>1902</td><td>96</td><td>7,045</td><td>18.0</td><td>no</td></tr>
    <tr><td>Tern Rock</td><td>1861</td><td>305</td><td>120,900</td><td>42.25</td><td>yes</td></tr>
    <tr><td>Low Ness</td><td>1902</td><td>58</td><td>960</td><td>12.5</td><td>no</td></tr>
  </tbody>
</table>
<h2>Boats</h2>
<p>They leave from the old pier.</p>
<table id="boats">
  <tr><th>Ferry</th><th>Minutes</th><th>Route</th><th>Fare</th></tr>
  <tr><td>Marta</td><td>35</td><td>Inner bay</td><td>1,250</td></tr>
  <tr><td>Gannet</td><td>90</td><td>Islands</td><td>980</td></tr>
  <tr><td>Old Tom</td><td>20</td><td>Inner bay</td><td>400</td></tr>
</table>
</body></html>"""

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(sheets: dict[str, list[list]], dates: tuple[str, ...] = ()) -> bytes:
    """Minimal .xlsx bytes: text as shared strings, numbers, booleans; None leaves a cell out.
    Cells of the references in ``dates`` get a date style."""
    shared: list[str] = []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listing, rels = "", ""
        for n, (name, rows) in enumerate(sheets.items(), 1):
            xml = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    ref = f"{chr(65 + c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, bool):
                        cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, (int, float)):
                        style = ' s="1"' if ref in dates else ""
                        cells += f'<c r="{ref}"{style}><v>{v}</v></c>'
                    elif v.startswith("inline:"):
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{escape(v[7:])}</t></is></c>'
                    else:
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                xml += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {_NS}><sheetData>{xml}</sheetData></worksheet>")
            listing += f'<sheet name="{escape(name)}" sheetId="{n}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="rId{n}"/>'
            rels += f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>'
        z.writestr("xl/workbook.xml", f"<workbook {_NS}><sheets>{listing}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {_NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
    return out.getvalue()
