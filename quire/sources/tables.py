"""Parquet tables of a data folder, read with only the columns that are asked for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WARN = "struct<code:string,message:string,severity:string,page_index:int>"
REF = f"struct<page_index:int,block_id:string,bbox:{BOX},engine:string>"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of ``folder``; with ``columns``, only these, so that the scan reads no others."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return df.select(*columns) if columns else df
