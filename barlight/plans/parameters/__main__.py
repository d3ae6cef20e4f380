from barlight.plans.parameters import main

main()
