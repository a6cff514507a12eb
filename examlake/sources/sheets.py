"""Workbooks (.xlsx) of reports, one for each group of rows; standard library only."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def workbook(title: str, header: list[str], rows: list[list]) -> bytes:
    """One sheet; texts are inline strings, numbers numbers. The bytes depend on the contents alone."""

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in [header, *rows])
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in files.items():
            archive.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, order: str, title: str, columns: dict[str, str]) -> DataFrame:
    """key, content: a workbook for each key, with the given columns (name: heading) in order. A group is one attempt or paper."""

    def build(pdf):
        import pandas as pd

        cells = pdf.sort_values(order)[list(columns)].astype(object).where(lambda x: x.notna(), None).to_numpy().tolist()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [workbook(title, list(columns.values()), cells)]})

    return rows.groupBy(key).applyInPandas(build, f"{key} {dict(rows.dtypes)[key]}, content binary")
