"""jobweir: job-posting analytics as Spark DataFrame and Column functions."""
