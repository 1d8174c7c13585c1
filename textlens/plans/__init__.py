"""Registered queries: Spark plans (``catalog``) and their SQL twins (``oracle``)."""
