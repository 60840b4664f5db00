"""Query plans as rows, and the library's queries over the test tables."""
