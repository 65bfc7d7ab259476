"""Three small extracts of one invented staff, for trying the engine out: two delimited ones and a workbook.

They hold one case of each kind that people decide: other headers for one field, two columns for one field, a date of two
readings, a status that is unknown, workplaces that differ, one person under two numbers, a missing address.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession

from tributary.sources.delimited import parse_rows, read_upload
from tributary.sources.workbook import workbook_bytes

ROSTER = """Site,Worker Type,Staff Name,Pernr,Hired On,Business Unit,Job Role,Position,HR Status,Birthday,Sex
Lisbon,Permanent,"Moreau, Ines",4711,09-Mar-2017,Dockside,Foreman,Crane foreman,Active,1984-02-29,W
Porto,Contractor,Prof. Odd Hauge,4712,2020-11-30,Workshop,Fitter,Fitter,Sabbatical,08/04/1986,Man
Faro,Internship,TEO BRANCO,4713,"Oct 5, 2021",Stores,Packer,Packer,A,24/12/1999,M
"""
SALARIES = """Annual Salary,Ccy,Staff ID
41000,EUR,4711
"38,500",,4712
29900,EUR,4713
"""
CONTACTS = """Cell,Family Name,Given Name,Email Address,Personnel Number,Workplace,Supervisor ID
9123450001,Moreau,Ines,ines.moreau@harbour.example,4711,Lisbon Harbour,4713
9123450002,Hauge,Odd,odd.h@yahoo.com,4712,Braga,4711
91-2345-0003,Branco,Teo,,4713,Faro,4711
9123450003,Branco,T,t.branco@harbour.example,4713X,Faro,4711
"""


def extracts(spark: SparkSession) -> list[tuple[str, DataFrame]]:
    """(file name, frame), the third through a workbook."""
    book = base64.b64encode(workbook_bytes(*parse_rows(CONTACTS))).decode()
    return [
        ("roster.csv", read_upload(spark, "roster.csv", text=ROSTER)),
        ("salaries.csv", read_upload(spark, "salaries.csv", text=SALARIES)),
        ("contacts.xlsx", read_upload(spark, "contacts.xlsx", base64_data=book)),
    ]
