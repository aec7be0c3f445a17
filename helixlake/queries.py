"""All queries of the core, and the SQL they must agree with."""

from helixlake.plans import genomics, keys, quality, runs, search, spectra

QUERIES = {}
SQL = {}
for part in (spectra, search, quality, genomics, runs, keys):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
