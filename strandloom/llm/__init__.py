"""Training-data operators: archives, mixing, filtering, de-duplication, packing and scoring.

Nothing outside this subpackage imports it. ``registry.queries()`` lists the
thin ``opN_<name>`` queries; the modules hold the general operators.
"""
