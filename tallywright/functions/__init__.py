"""Column functions: text in, column out. Nothing here touches a DataFrame."""
