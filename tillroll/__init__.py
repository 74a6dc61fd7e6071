"""tillroll — Spark-native cleaning, pseudonymisation and reporting for
point-of-sale transaction tables.

Layout
------
sources/    readers, writers and the derived fixture views
functions/  ``Column -> Column`` builders (row-local, codegen friendly)
operators/  ``DataFrame -> DataFrame`` operators (profiling, ordering,
            aggregation, masking, revenue, customers, products, quality)
plans/      end-to-end compositions and the query registry
streaming/  applying the row-local operators to streaming DataFrames
"""

__version__ = "0.1.0"
