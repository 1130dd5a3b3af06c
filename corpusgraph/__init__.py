"""Spark jobs over large collections of software projects and proposed changes.

The package is organised by role:

* ``functions``  column expressions (no shuffle, stay inside one row)
* ``sources``    readers, discovery and sinks
* ``operators``  DataFrame -> DataFrame jobs (joins, grouping, windows, loops)
* ``plans``      loop, checkpoint and skew helpers shared by the operators
* ``streaming``  Structured Streaming counterparts
* ``catalog``    named queries over the test tables with their SQL twins
"""
