"""rooftop: Spark table jobs that estimate rooftop solar potential.

Layout
------
``sources``    table declarations (read / write), catalogue and irradiance files
``functions``  column expressions: text cleaning, parsing, formulas
``operators``  DataFrame -> DataFrame jobs (addresses, yields, adoption, roofs,
               irradiance, emissions, numbering)
``plans``      job runner, join helpers, the registered query set
``streaming``  the streaming form of the hourly irradiance fold

``python -m rooftop <job> ...`` runs one table job (see ``rooftop.__main__``).
"""

__version__ = "0.1.0"
