"""Record schemas of the document pipeline, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SOURCE = "name string, url string, collected_at string"
DOCUMENT = (
    "id string, type string, domain string, title string, content string, source struct<name:string,url:string,collected_at:string>, "
    "effective_date string, related_laws array<struct<law_id:string,law_name:string,article_ref:string>>, metadata map<string,string>"
)
BENCHMARK = "id int, question string, domain string, expected_keywords array<string>"
EVALUATION = "id string, question string, ground_truth string, domain string, difficulty string"
LAWS = (
    "laws array<struct<law_id:string,name:string,ministry:string,enforcement_date:string,articles:array<struct<number:string,title:string,content:string,"
    "clauses:array<struct<number:string,content:string,items:array<struct<number:string,content:string>>>>>>>>"
)
CHUNK = "id string, chunk_type string, parent_id string, child_index int, body string, collection string"


def schema_with(df: DataFrame, added: str) -> T.StructType:
    """The schema of ``df`` followed by the columns of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
