"""gridlake: find, clean and analyse tables buried in pages and text, on Spark."""
