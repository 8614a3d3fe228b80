"""Spark types shared by all operators."""

from pyspark.sql.types import StructType

LOC = "struct<line:int,column:int,offset:int>"
ERR = f"struct<kind:string,found:string,expected:array<string>,message:string,loc:{LOC}>"
EDIT = "struct<start:int,end:int,new_text:string>"
#: A node; ``path`` (child indexes from the root) and ``structure`` (a hash of kinds, texts and shape of all below) are null unless asked for.
NODE = "doc_id bigint, node_id int, last_desc int, parent_id int, child_index int, depth int, node_class string, kind string, text string, width int, offset int, path array<int>, structure bigint"


def result_type(value: str, trace: bool = False) -> str:
    """RESULT over a value type: Success, Partial or Failure as one struct, with a trace if asked for."""
    more = ",trace:array<struct<label:string,start:int,end:int,value:string>>" if trace else ""
    return f"struct<status:string,value:{value},errors:array<{ERR}>,consumed:int,furthest:{LOC}{more}>"


def fields(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
