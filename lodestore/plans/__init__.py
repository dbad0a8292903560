"""The plan builder: an ordered queue of requests becomes DataFrame lineage."""
