"""Text-corpus operators: splitting, entity resolution, masking, encoding, packing and shared spans.

Nothing outside this sub-package imports it; ``catalogue.queries()`` lists its queries.
"""
