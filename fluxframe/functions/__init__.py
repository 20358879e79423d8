"""Column expressions. Nothing here touches a DataFrame; Catalyst sees plain expressions."""
