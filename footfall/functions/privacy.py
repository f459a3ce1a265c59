"""Addresses leave the job only as salted hashes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.settings import parse_salt


def ip_hash(address: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(parse_salt(salt)), address), 256)
